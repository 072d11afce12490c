"""Texts that license scans look for."""

#: Public licence texts and notices, whole or up to their disclaimers, by name. The label is the part
#: before the slash.
TEMPLATES = {
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted. The software is provided "as is" and the author disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness.""",
    "agpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        without any warranty; without even the implied warranty of merchantability or fitness for a particular
        purpose. See the GNU Affero General Public License for more details.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "as is" basis, without warranties or conditions of any
        kind, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "apache-2/opening": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License.""",
    "bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. This software is provided by the copyright holders and
        contributors "as is" and any express or implied warranties, including, but not limited to, the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the
        copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or
        consequential damages (including, but not limited to, procurement of substitute goods or services; loss of
        use, data, or profits; or business interruption) however caused and on any theory of liability, whether in
        contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of
        this software, even if advised of the possibility of such damage.""",
    "bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. This software is provided by the copyright holders and contributors "as is" and any
        express or implied warranties, including, but not limited to, the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be
        liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not
        limited to, procurement of substitute goods or services; loss of use, data, or profits; or business
        interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
        (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
        possibility of such damage.""",
    "bsd-2/opening": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "bsl-1": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices
        in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
        works of the Software, unless such copies or derivative works are solely in the form of machine-executable
        object code generated by a source language processor.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial International License",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives International License",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike International License",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution NoDerivatives International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike International License",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work.""",
    "epl-2": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at""",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but without
        any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street,
        Fifth Floor, Boston, MA 02110-1301 USA.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but without
        any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see http://www.gnu.org/licenses.""",
    "gpl/opening": """This program is free software you can redistribute it and/or modify it under the terms of the GNU
        General Public License""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The
        software is provided "as is" and the author disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness. In no event shall the author be liable for any special,
        direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or
        profits, whether in an action of contract, negligence or other tortious action, arising out of or in
        connection with the use or performance of this software.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        without any warranty; without even the implied warranty of merchantability or fitness for a particular
        purpose. See the GNU Lesser General Public License for more details.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. The software is provided "as is", without warranty of any kind, express
        or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose
        and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or
        other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection
        with the software or the use or other dealings in the software.""",
    "mit/opening": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "mpl-2/opening": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "ncsa": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal with the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimers in the documentation and/or other materials provided with the
        distribution. Neither the names of the developers, nor the names of its contributors may be used to endorse or
        promote products derived from this Software without specific prior written permission.""",
    "ofl-1.1": """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied
        below, and is also available with a FAQ at""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose,
        without fee, and without a written agreement is hereby granted, provided that the above copyright notice and
        this paragraph and the following two paragraphs appear in all copies.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
        to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law.""",
    "wtfpl": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and
        changing it is allowed as long as the name is changed.""",
    "zlib": """This software is provided "as-is", without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. This notice may not be removed or
        altered from any source distribution.""",
}

"""License scans as an exact set-similarity join with templates (native).

A template is a licence's text or notice. It is found in a block of a text if the block holds at least `threshold` of
the template's distinct words. Blocks of a template have twice `half` words and begin every `half` words, `half` being
at least the template's length, so any passage as long as the template lies whole in some block. Words of the templates
are ordered by how many documents of the whole table hold them, rarest first. The join is on postings of words, with
filters that are all exact:

* documents that don't hold the words needed of any template anywhere have no blocks (one pass finds them, and the
  words' frequencies);
* prefix: a block that reaches the threshold holds one of the first |T| - need + 1 words of the template; only these
  words are postings, so only blocks that hold one become candidates;
* length: a block with fewer than `need` words can't;
* position: with its first match at place p of the template's order, it can match |T| - p words at most.

What remains is verified by intersecting sets. Templates that nearly contain each other (licences of one family) have
blocks of one size; a finding that another such template beats in the same block or one that overlaps it (by words
held, then by share) is dropped, so a notice gets the label of its own variant alone. Equal texts are joined once. The small side
of the postings join is made from the templates, so its size is fixed by a parameter.

Besides, phrases are found exactly where their words stand consecutively.

Edge cases: null text counts as empty: no words, no places, empty labels, score 0. Repeated rows are scanned each.
An empty table gives an empty table. Input columns with the names of output columns are replaced; the prefix `__li_`
is reserved. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, quoted, without
from .license_texts import TEMPLATES

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
#: Copies of the table of findings, so that rows of one text spread over so many tasks.
SALTS = 16


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]  # distinct, sorted
    need: int
    half: int
    rivals: tuple[str, ...]

    @property
    def label(self) -> str:
        return self.name.split("/")[0]


def words(text: Column, ascii_only: bool = True) -> Column:
    """The words of a text. If they are only compared with ASCII words (`ascii_only`), all letters may be lower-cased,
    which is much faster: it moves no word's ends, and but for the Kelvin sign none but ASCII letters become ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")), ascii_lower(text)).otherwise(F.lower(text)) if ascii_only else ascii_lower(text)
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def prepared(templates: dict[str, str], threshold: float) -> list[Template]:
    """Templates by name, with words needed, block sizes, and rivals: templates of other labels that nearly hold it."""
    lists = {k: re.findall(TOKEN, t.translate(str.maketrans(UPPER, LOWER))) for k, t in sorted(templates.items())}
    sets = {k: set(w) for k, w in lists.items()}
    need = {k: math.ceil(threshold * len(s) - 1e-9) for k, s in sets.items()}
    rivals = {k: [x for x in sets if x.split("/")[0] != k.split("/")[0] and len(sets[x] & sets[k]) >= need[k]] for k in sets}
    family = {k: k for k in sets}
    for _ in sets:  # the smallest name of all that are rivals of rivals
        for k, others in rivals.items():
            for x in others:
                family[k] = family[x] = min(family[k], family[x])
    longest = {f: max(len(lists[k]) for k in sets if family[k] == f) for f in family.values()}
    half = {k: 1 << max(4, (longest[family[k]] - 1).bit_length()) for k in sets}
    return [Template(k, tuple(sorted(sets[k])), need[k], half[k], tuple(rivals[k])) for k in sets]


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def findings(docs: DataFrame, text: Column, known: list[Template], ascii_only: bool) -> DataFrame:
    """(digest, labels, share) for each distinct text that holds templates."""
    vocabulary = sorted({w for t in known for w in t.words})
    rows = docs.select(F.md5(text.cast("binary")).alias("digest"), words(text, ascii_only).alias("w")).withColumn("v", F.array_intersect("w", literals(vocabulary)))
    able = reduce(lambda a, t: a | (F.size(F.array_intersect("v", literals(t.words))) >= t.need), known, F.lit(False))
    able = (F.size("v") >= min((t.need for t in known), default=0)) & able
    rows = cut(rows.select("digest", "v", F.when(able, F.col("w")).alias("w")), "license-words")
    # one row for each word of the templates
    counts = {r["x"]: r["n"] for r in rows.select(F.explode("v").alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}
    postings = []
    for t in known:
        order = sorted(t.words, key=lambda w: (counts.get(w, 0), w))
        postings += [(w, t.name, place, len(order), t.need, t.half) for place, w in enumerate(order[: len(order) - t.need + 1])]
    postings = F.broadcast(docs.sparkSession.createDataFrame(postings, "x string, name string, place int, total int, need int, half int"))
    texts = rows.filter("w is not null").groupBy("digest").agg(F.first("w").alias("w"))
    texts = cut(texts, "license-texts")
    places = texts.select("digest", F.size("w").alias("n"), F.posexplode("w").alias("p", "x")).join(postings, "x")
    last = F.floor(F.col("p") / F.col("half")).cast("int")
    blocks = places.withColumn("k", F.explode(F.array_distinct(F.array(F.greatest(last - 1, F.lit(0)), last))))
    blocks = blocks.groupBy("digest", "name", "k", "n", "total", "need", "half").agg(F.min("place").alias("first"))
    blocks = blocks.filter("n - k * half >= need").filter("total - first >= need")
    of = F.create_map(*[x for t in known for x in (F.lit(t.name), literals(t.words))])
    verified = texts.join(blocks.groupBy("digest").agg(F.collect_list(F.struct("name", "k", "total", "need", "half")).alias("c")), "digest")
    shared = lambda c: F.size(F.array_intersect(F.slice("w", c["k"] * c["half"] + 1, 2 * c["half"]), F.element_at(of, c["name"])))
    c = F.filter(F.transform("c", lambda c: F.struct(*[c[x].alias(x) for x in ("name", "k", "total", "need", "half")], shared(c).alias("both"))), lambda c: c["both"] >= c["need"])
    met = verified.select("digest", F.inline(c)).select("digest", "half", "k", "name", "both", (F.col("both") / F.col("total")).alias("share"))
    met = cut(met, "license-met")
    near = met.select("digest", "half", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"), F.col("name").alias("other"), F.struct("both", "share").alias("theirs"))
    rivals = F.create_map(*[x for t in known for x in (F.lit(t.name), literals(t.rivals) if t.rivals else F.array().cast("array<string>"))])
    beaten = met.join(near, ["digest", "half", "k"]).filter(F.array_contains(F.element_at(rivals, F.col("name")), F.col("other")) & (F.col("theirs") > F.struct("both", "share")))
    met = met.join(beaten.select("digest", "k", "name").distinct(), ["digest", "k", "name"], "left_anti")
    return met.groupBy("digest").agg(F.collect_set(F.substring_index("name", "/", 1)).alias("labels"), F.max("share").alias("share"))


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """All columns of docs, and those of OUT: word count, phrase places (number, smallest and largest start word),
    labels of the phrases, labels of phrases and templates, and the best containment of any template (1 for a
    phrase). See the module."""
    keep = without(docs, OUT)
    known = prepared(templates, threshold)
    ascii_only = all(map(str.isascii, phrases)) and all(w.isascii() for t in known for w in t.words)
    found = cut(findings(docs, quoted(text), known, ascii_only), "license-findings") if known else None
    rows = docs.select(*[quoted(c) for c in keep], F.md5(quoted(text).cast("binary")).alias("__li_digest"), words(quoted(text), ascii_only).alias("__li_words"))

    joined = F.concat(F.lit(" "), F.array_join("__li_words", " "), F.lit(" "))
    rows = rows.withColumn("__li_text", joined)
    n = F.size("__li_words")

    def places(phrase: str) -> Column:
        want = phrase.split()
        at = F.sequence(F.lit(0), n - len(want))
        same = lambda i: F.slice("__li_words", i + 1, len(want)) == literals(want)
        return F.when(F.contains("__li_text", F.lit(f" {phrase} ")), F.filter(at, lambda i: (F.element_at("__li_words", i + 1) == want[0]) & same(i))).otherwise(F.array().cast("array<int>"))

    for k, phrase in enumerate(phrases):
        rows = rows.withColumn(f"__li_p{k}", places(phrase))
    rows = rows.withColumn("__li_all", F.concat(*[F.col(f"__li_p{k}") for k in range(len(phrases))]) if phrases else F.array().cast("array<int>"))
    base = F.array_compact(F.array(*[F.when(F.size(f"__li_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]).cast("array<string>"))
    rows = rows.withColumn("__li_base", F.array_sort(F.array_distinct(base)))
    rows = rows.select(
        *[quoted(c) for c in keep], "__li_digest", "__li_base", n.cast("long").alias("n_words"), F.size("__li_all").cast("long").alias("n_base"),
        F.array_min("__li_all").cast("long").alias("first_word"), F.array_max("__li_all").cast("long").alias("last_word"),
    )
    none = F.array().cast("array<string>")
    if found is None:
        rows = rows.withColumns({"__li_labels": none, "__li_share": F.lit(0.0)})
    else:
        # a text on very many rows spreads over SALTS tasks
        salted = found.select(F.col("digest").alias("__li_of"), F.col("labels").alias("__li_labels"), F.col("share").alias("__li_share"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__li_salt2"))
        rows = rows.withColumn("__li_salt", F.floor(F.rand(7) * SALTS).cast("int"))
        rows = rows.join(salted, (F.col("__li_digest") == F.col("__li_of")) & (F.col("__li_salt") == F.col("__li_salt2")), "left")
    labels = F.array_join(F.array_sort(F.array_union("__li_base", F.coalesce("__li_labels", none))), ",")
    score = F.greatest(F.coalesce("__li_share", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select(*[quoted(c) for c in keep], *OUT[:4], F.array_join("__li_base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))

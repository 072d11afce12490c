"""The built-in operators. Each is written once, over the functions of columns or arrays that it is given."""


def load() -> None:
    """Fills the registry."""
    from . import azimuthal, cylindrical, elementary, grids, polynomial, pseudo, transforms  # noqa: F401

"""Sources of trees; importing the package registers the readers of all languages."""

from treeline.sources import native  # noqa: F401

"""One registered query per operator; the registry loads all of them, in an order in which none needs a later one."""

from . import registry  # noqa: F401

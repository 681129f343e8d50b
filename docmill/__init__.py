"""Document intelligence expressed as Spark DataFrame operators."""

from docmill.settings import Rules, Settings, load_rules

__all__ = ["Rules", "Settings", "load_rules"]

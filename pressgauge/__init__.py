"""Regional topic analytics over dated, place-tagged article tables, on Spark."""

from pressgauge.config import Settings, Topic, load_settings

__all__ = ["Settings", "Topic", "load_settings"]

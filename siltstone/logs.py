"""Log lines of the package, set up from one description."""

from __future__ import annotations

import logging
import logging.config
from pathlib import Path


def log_to(path: str | None = None, level: str = "INFO") -> logging.Logger:
    """The package's logger: on the console, and in a file of the driver if one is named. The last call holds."""
    outputs = {"console": {"class": "logging.StreamHandler", "stream": "ext://sys.stdout", "formatter": "line"}}
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        outputs["file"] = {"class": "logging.FileHandler", "filename": path, "encoding": "utf-8", "formatter": "line"}
    logging.config.dictConfig({
        "version": 1, "disable_existing_loggers": False, "formatters": {"line": {"format": "{asctime} {levelname} {name}: {message}", "style": "{"}},
        "handlers": outputs, "loggers": {"siltstone": {"level": level, "handlers": list(outputs)}},
    })
    return logging.getLogger("siltstone")

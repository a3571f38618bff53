"""Settings: defaults with a user's values over them, checked before anything runs."""

from __future__ import annotations

import json
import tomllib
from copy import deepcopy

#: Defaults, which also tell what settings there are and of what kind.
DEFAULTS = {
    "document": {"output_name_template": "", "file_name_slugs": False, "no_dirs": False, "fix_zip_code_page": "", "toc": {"shape": "normal", "levels": 6, "untitled": False}},
    "notes": {"bodies": ["notes", "comments", "footnotes"], "mode": "default", "label_template": "{{ .NoteNumber }}", "backlink_template": ""},
    "pages": {"size": 2300, "locations": 40},
    "text": {"speech": ["«", '"'], "dashes": ["-", "—"], "dialogue": ["—", " "], "dropcaps_ignore": "\"'«„—-"},
    "screen": {"width": 1264, "height": 1680, "dpi": 300},
}

#: What values may be.
CHOICES = {("document", "toc", "shape"): ("normal", "flat", "old_kindle"), ("notes", "mode"): ("default", "float", "float_renumbered")}
POSITIVE = (("pages", "size"), ("pages", "locations"), ("screen", "width"), ("screen", "height"), ("screen", "dpi"), ("document", "toc", "levels"))

#: Formats that a target takes.
TARGETS = {"epub": ("epub2", "epub3", "kepub"), "kindle": ("kfx", "azw8"), "text": ("txt", "md"), "print": ("pdf",)}


def overlaid(base: dict, over: dict, path: tuple[str, ...] = ()) -> dict:
    """base with the values of `over`; a name that base doesn't have, or a value of another kind, is an error."""
    out = deepcopy(base)
    for key, value in over.items():
        at = ".".join((*path, key))
        if key not in base:
            raise ValueError(f"{at} isn't a setting")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ValueError(f"{at} has settings of its own")
            out[key] = overlaid(base[key], value, (*path, key))
        elif type(value) is not type(base[key]):
            raise ValueError(f"{at} must be of the kind {type(base[key]).__name__}")
        else:
            out[key] = deepcopy(value)
    return out


def checked(settings: dict) -> dict:
    def at(path: tuple[str, ...]):
        value = settings
        for p in path:
            value = value[p]
        return value

    for path, choices in CHOICES.items():
        if at(path) not in choices:
            raise ValueError(f"{'.'.join(path)} must be one of {', '.join(choices)}")
    for path in POSITIVE:
        if at(path) <= 0:
            raise ValueError(f"{'.'.join(path)} must be above 0")
    return settings


def load(text: str = "", form: str = "toml") -> dict:
    """Settings of a TOML or JSON text over the defaults."""
    given = (tomllib.loads(text) if form == "toml" else json.loads(text)) if text.strip() else {}
    return checked(overlaid(DEFAULTS, given))


def takes(target: str, form: str) -> bool:
    """Whether a target takes a format."""
    return form in TARGETS.get(target, ())

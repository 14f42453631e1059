"""Settings files: JSON, INI and Fortran namelists, read on the driver."""

from __future__ import annotations

import configparser
import json
import re
from pathlib import Path


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def read_ini(path: str) -> dict[str, dict[str, str]]:
    """Sections of options, as text; names keep their case, and ';' and '#' begin comments."""
    p = configparser.ConfigParser(inline_comment_prefixes=(";", "#"), interpolation=None)
    p.optionxform = str
    p.read(path)
    return {s: dict(p.items(s)) for s in p.sections()}


def _value(text: str):
    t = text.strip().rstrip(",")
    if m := re.fullmatch(r"(['\"])(.*)\1", t):
        return m[2]
    if t.lower() in (".true.", ".t."):
        return True
    if t.lower() in (".false.", ".f."):
        return False
    for kind, form in ((int, t), (float, t.lower().replace("d", "e"))):
        try:
            return kind(form)
        except ValueError:
            pass
    return t


def read_namelist(path: str) -> dict[str, dict]:
    """Groups &name ... / of key = value lines; '!' begins a comment outside quotes."""
    out: dict[str, dict] = {}
    group: dict | None = None
    for line in Path(path).read_text().splitlines():
        line = re.sub(r"^((?:[^'\"!]|'[^']*'|\"[^\"]*\")*)!.*", r"\1", line).strip()
        if line.startswith("&"):
            group = out.setdefault(line[1:].split()[0].lower(), {})
        elif line == "/":
            group = None
        elif "=" in line and group is not None:
            key, value = line.split("=", 1)
            group[key.strip().lower()] = _value(value)
    return out


def write_namelist(groups: dict[str, dict]) -> str:
    def text(v) -> str:
        return (".TRUE." if v else ".FALSE.") if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)

    return "".join(f"&{g}\n" + "".join(f"{k} = {text(v)}\n" for k, v in own.items()) + "/\n" for g, own in groups.items())

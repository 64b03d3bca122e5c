"""Frontmatter: the block of YAML at the head of a Markdown text."""

from __future__ import annotations

import json
import re
from typing import Any

import yaml

_OPEN = re.compile(r"---(?:\r\n|\n)")
_CLOSE = re.compile(r"(?:^|(?<=\n))---(?=\r?\n|\Z)")


class FrontmatterError(ValueError):
    """The block isn't valid YAML."""


class _Loader(yaml.SafeLoader):
    """Only null, booleans, integers and floats are resolved; what looks like a
    date, a time or a yes/no word stays a string."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN"),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$|^0x[0-9a-fA-F]+$|^0o[0-7]+$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][-+]?[0-9]+)?$|^[-+]?[0-9]+[eE][-+]?[0-9]+$", "-+.0123456789"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), [*_first, *([""] if _tag == "null" else [])])


def _integer(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> int:
    text = node.value.replace("+", "")
    return int(text, 0) if text[:2] in ("0x", "0o") else int(text)


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)


def split(content: str) -> tuple[str | None, str]:
    """(YAML, body). The text must begin with a line ``---``; the next line that
    is exactly ``---`` closes. Without a closing line all of it is body; an empty
    block is no frontmatter, but the body still begins behind it."""
    head = _OPEN.match(content)
    if not head:
        return None, content
    shut = _CLOSE.search(content, head.end())
    if not shut:
        return None, content
    text = content[head.end() : shut.start()]
    body = re.sub(r"\A\r?\n", "", content[shut.end() :])
    return (text if text.strip() else None), body


def load(text: str) -> Any:
    """The YAML block as plain JSON values."""
    try:
        return _plain(yaml.load(text, Loader=_Loader))  # noqa: S506 - a safe loader
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise FrontmatterError(f"invalid frontmatter: {e}") from e


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k if isinstance(k, str) else dumps(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if x is None or isinstance(x, (str, bool, int)):
        return x
    if isinstance(x, float):
        return x if x == x and abs(x) != float("inf") else None
    return str(x)


def dumps(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def title(matter: Any) -> str | None:
    """The trimmed, non-empty string under ``title``."""
    value = matter.get("title") if isinstance(matter, dict) else None
    return value.strip() or None if isinstance(value, str) else None


def tags(matter: Any) -> list[tuple[str, str]]:
    """(key, value as JSON) in order of keys; a list gives one tag per element,
    an empty one none."""
    out = []
    for key in sorted(matter) if isinstance(matter, dict) else ():
        value = matter[key]
        out += [(key, dumps(v)) for v in (value if isinstance(value, list) else [value])]
    return out

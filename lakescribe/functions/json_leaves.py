"""The scalar leaves of a JSON text."""

from __future__ import annotations

import json

_NAMED = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}


class _Number(str):
    """A number in its plain text, so that it is neither rounded nor cut."""


_DECODER = json.JSONDecoder(
    # whole numbers keep all digits; others are the shortest text of a double
    parse_int=lambda digits: _Number("0" if digits == "-0" else digits), parse_float=lambda text: _Number(repr(float(text))),
    parse_constant=lambda word: _Number(_NAMED[word]),
)
_PLAIN = {True: "true", False: "false", None: None}


def json_leaves(text: str) -> list[tuple[str, str | None]] | None:
    """(dotted name, value) of the scalars of a document; None if the text is no JSON.

    Of equal names in an object the last one counts, with all that stands below it. Numbers are written as
    1, 1.0, 1e+16, nan, inf; a text stays a text. Lists and what they hold are left out. A document that is
    one scalar has the name ''. Half of a surrogate pair becomes a question mark. Texts nested too deeply
    for the parser (some ten thousand levels) are no JSON.
    """
    try:
        document = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    leaves, waiting = [], [("", document)]
    while waiting:
        name, value = waiting.pop()
        if isinstance(value, dict):
            waiting.extend((f"{name}.{key}" if name else key, item) for key, item in value.items())
        elif isinstance(value, str):
            leaves.append((_whole(name), _whole(value)))
        elif not isinstance(value, list):
            leaves.append((_whole(name), _PLAIN[value]))
    return leaves


def _whole(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()

"""Objects that are not tables, as bytes.

Loading a pickle runs code that its author chose, so artifacts are as trusted as whoever can
write to the store. Plain values (numbers, texts, lists and dicts of them) are kept as JSON,
which runs nothing.
"""

from __future__ import annotations

import json
import pickle

_JSON, _PICKLE = b"J", b"P"


def dumps(value: object) -> bytes:
    """The same bytes for equal values of equal history."""
    try:
        text = json.dumps(value, sort_keys=False, allow_nan=False)
        if json.loads(text) == value and _plain(value):
            return _JSON + text.encode()
    except (TypeError, ValueError):
        pass
    return _PICKLE + pickle.dumps(value, protocol=5)


def _plain(value: object) -> bool:
    if type(value) is dict:
        return all(type(k) is str and _plain(v) for k, v in value.items())
    if type(value) is list:
        return all(map(_plain, value))
    return value is None or type(value) in (str, int, float, bool)


def loads(data: bytes, trusted: bool = True) -> object:
    if data[:1] == _JSON:
        return json.loads(data[1:])
    if not trusted:
        raise ValueError("this artifact is a pickle, which an untrusting reader does not load")
    return pickle.loads(data[1:])

"""What besides its text a step's code depends on: values that a function carries, and project modules that it imports."""

from __future__ import annotations

import ast
import dis
import functools
import importlib
import importlib.util
import inspect
import math
import os
import pickle
import sys
import sysconfig
import textwrap
import threading
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from .functions.hashing import md5, normal_code

_HERE = os.path.dirname(os.path.abspath(__file__)) + os.sep
_LIBRARIES = tuple({os.path.realpath(p) + os.sep for k, p in sysconfig.get_paths().items() if k in ("stdlib", "platstdlib", "purelib", "platlib")})
#: Hash of each project module's file when it was loaded.
_LOADED: dict[str, str] = {}
#: Runs side by side look at modules one at a time.
_LOCK = threading.RLock()
#: Functions whose values are being put in words.
_OPEN: ContextVar[frozenset[int]] = ContextVar("tallyrun_open", default=frozenset())


#: Between what a recorded function needs and the function itself.
STEP = "# --- step ---"


def with_values(text: str, function: Callable) -> str:
    """The text of a function with all that it takes from its own module, and what tells it from others of the same text.

    Above it stand, each before what uses it, the helpers, classes and constants of its module
    that it reaches by name, directly or through each other, and the imports that these use,
    so that the whole can be run again by itself. Below it, as comments, are its default
    values, the values it closes over and, as several lambdas can stand on one line, a
    lambda's own instructions.
    """
    if getattr(function, "__code__", None) is None:
        return text
    reached = _Reached()
    reached.follow(function)
    token = _OPEN.set(_OPEN.get() | {id(function)})
    below = _carried(function)
    _OPEN.reset(token)
    if function.__name__ == "<lambda>":
        below.append(f"# lambda: {_instructions(function.__code__)}")
    above = [*reached.lines, STEP] if reached.lines else []
    return "\n".join([*above, text.rstrip("\n"), *below]) + "\n" if above or below else text


def _carried(function: Callable, of: str = "") -> list[str]:
    """Default values and the values closed over, as comments."""
    lines = []
    if function.__defaults__ or function.__kwdefaults__:
        lines.append(f"# {of}defaults: {_said((function.__defaults__, function.__kwdefaults__))}")
    for name, cell in zip(function.__code__.co_freevars, function.__closure__ or (), strict=True):
        try:
            lines.append(f"# {of}{name} = {_said(cell.cell_contents)}")
        except ValueError:  # not yet bound
            lines.append(f"# {of}{name} is unbound")
    owner = getattr(function, "__self__", None)
    if owner is not None:
        lines.append(f"# {of}self = {_said(owner)}")
    return lines


def _instructions(code: types.CodeType) -> str:
    return md5(repr((code.co_names, _constants(code))) + code.co_code.hex())


class _Reached:
    """What a function reaches by the global names in its code and in that of its module's helpers."""

    def __init__(self):
        self.lines: list[str] = []
        self.functions: list[Callable] = []
        self._seen: set = set()

    def follow(self, function: Callable) -> None:
        function = getattr(function, "__func__", function)
        if id(function) in self._seen:
            return
        self._seen.add(id(function))
        self.functions.append(function)
        inner = inspect.unwrap(function)
        if inner is not function and hasattr(inner, "__code__"):
            self.follow(inner)
        for name in sorted(_global_names(function.__code__)):
            if name in function.__globals__:
                self._name(name, function.__globals__[name], function.__module__, function.__globals__)

    def _name(self, name: str, value, own: str, space: dict) -> None:
        if (id(space), name) in self._seen:
            return
        self._seen.add((id(space), name))
        if isinstance(value, types.ModuleType):
            self.lines.append(f"import {value.__name__} as {name}" if name != value.__name__ else f"import {name}")
        elif isinstance(value, type) or hasattr(value, "__code__"):
            if getattr(value, "__module__", None) == own:
                self._helper(name, value)
            else:
                self.lines.append(f"from {value.__module__} import {value.__qualname__} as {name}")
        elif isinstance(value, functools.partial) and hasattr(value.func, "__code__"):
            if value.func.__module__ == own:
                self._helper(value.func.__name__, value.func)
            self.lines.append(f"# {name} is partial of {_said(value.func)} with {_said((value.args, value.keywords))}")
        else:
            self.lines.append(f"{name} = {value!r}" if _is_literal(value) else f"# {name} is {_said(value)}")

    def _helper(self, name: str, value) -> None:
        """A function or class of the module: first what it reaches, then its text."""
        parts = [value] if hasattr(value, "__code__") else _functions_in(value)
        for f in parts:
            self.follow(f)
        for base in getattr(value, "__bases__", ()):
            if base.__module__ == value.__module__:
                self._name(base.__name__, base, value.__module__, sys.modules[base.__module__].__dict__ if base.__module__ in sys.modules else {base.__name__: base})
        try:
            text = textwrap.dedent(inspect.getsource(value)).rstrip("\n")
        except (OSError, TypeError):
            text = f"# {name}: {[_instructions(f.__code__) for f in parts]}"
        self.lines += [text, *[c for f in parts for c in _carried(f, f"{f.__qualname__} ")]]
        if name != value.__name__ and not text.startswith(f"{name} ="):
            self.lines.append(f"{name} = {value.__name__}" if value.__name__.isidentifier() else f"# {name} is {value.__name__}")


def _functions_in(cls: type) -> list[Callable]:
    out = []
    for _, v in sorted(vars(cls).items(), key=lambda kv: kv[0]):
        for f in (v, getattr(v, "__func__", None), getattr(v, "fget", None), getattr(v, "fset", None)):
            if isinstance(f, types.FunctionType):
                out.append(f)
    return out


def _global_names(code: types.CodeType) -> set[str]:
    """Names that a code object and those within it look up among globals."""
    mine = {i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}
    return mine.union(*[_global_names(c) for c in code.co_consts if isinstance(c, types.CodeType)])


def _is_literal(value) -> bool:
    """Whether a value can be written down and read back; sets have no order to be written in."""
    if isinstance(value, (list, tuple)):
        return type(value) in (list, tuple) and all(map(_is_literal, value))
    if isinstance(value, dict):
        return type(value) is dict and all(map(_is_literal, [*value, *value.values()]))
    return type(value) in (type(None), bool, int, str, bytes) and len(repr(value)) <= 10_000 or type(value) is float and math.isfinite(value)


def _constants(code: types.CodeType) -> list:
    return [_constants(c) + [c.co_code.hex(), c.co_names] if isinstance(c, types.CodeType) else repr(c) for c in code.co_consts]


def _said(value, depth: int = 4) -> str:
    """A value in words that are the same in every process: plain values whole, others by type and hash."""
    if isinstance(value, (list, tuple)) and depth:
        return f"{type(value).__name__}({', '.join(_said(x, depth - 1) for x in value)})"
    if isinstance(value, (set, frozenset)) and depth:
        return f"{type(value).__name__}({', '.join(sorted(_said(x, depth - 1) for x in value))})"
    if isinstance(value, dict) and depth:
        return "{" + ", ".join(f"{_said(k, depth - 1)}: {_said(v, depth - 1)}" for k, v in value.items()) + "}"
    if value is None or isinstance(value, (bool, int, float, complex, str, bytes)):
        text = repr(value)
        return text if len(text) <= 200 and "\n" not in text else f"{type(value).__name__}:{md5(text)}"
    if callable(value) and hasattr(value, "__code__"):
        if id(value) in _OPEN.get():
            return value.__qualname__  # it is part of what it carries
        token = _OPEN.set(_OPEN.get() | {id(value)})
        try:
            return f"{value.__qualname__}:{md5(with_values(value.__code__.co_code.hex() + repr(_constants(value.__code__)), value))}"
        finally:
            _OPEN.reset(token)
    if isinstance(value, types.ModuleType):
        return value.__name__
    kind = f"{type(value).__module__}.{type(value).__qualname__}"
    if kind.split(".")[0] in ("pyspark", "tallyrun"):
        return kind  # handles of a session have no value of their own
    try:
        return f"{kind}:{md5(pickle.dumps(value, protocol=5))}"
    except Exception:  # what can't be pickled is known by its type and attributes
        held = getattr(value, "__dict__", None)
        return f"{kind}({_said(held, depth - 1)})" if held and depth and not isinstance(value, type) else kind


def _project_file(module: types.ModuleType | None) -> str | None:
    """The file of a module that is neither of Python, nor installed, nor this package."""
    path = getattr(module, "__file__", None)
    if not path or not path.endswith(".py"):
        return None
    path = os.path.realpath(path)
    return None if path.startswith(_HERE) or path.startswith(_LIBRARIES) or "site-packages" in path else path


def _hash(path: str) -> str:
    with open(path, "rb") as f:
        return md5(normal_code(f.read()))


def _names(text: str) -> Iterator[str]:
    """Modules that a text imports, anywhere in it."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def _module(name: str) -> types.ModuleType | None:
    if name in sys.modules:
        return sys.modules[name]
    try:
        found = importlib.util.find_spec(name)
    except (ImportError, ValueError):
        return None
    return types.SimpleNamespace(__file__=found.origin, __name__=name) if found and found.origin else None


def _follow(modules: list, found: dict[str, str]) -> bool:
    """Add the hashes by path of the project modules and of those that they import.

    Modules that were changed since they were loaded, and those that import them, are loaded
    anew; whether any was is returned.
    """
    anew = False
    for module in modules:
        path = _project_file(module)
        if not path or path in found:
            continue
        found[path] = now = _hash(path)
        with open(path, encoding="utf-8") as f:
            below = _follow([m for n in _names(f.read()) if (m := _module(n))], found)
        if isinstance(module, types.ModuleType) and module.__name__ in sys.modules and (below or _LOADED.get(path, now) != now):
            importlib.reload(module)
            anew = True
        _LOADED[path] = now
    return anew


def helpers_of_text(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    with _LOCK:
        _follow([m for n in _names(text) if (m := _module(n))], found)
    return found


def helpers_of(function: Callable) -> dict[str, str]:
    """Of a function and the helpers of its module that it reaches: modules that they import or name, and those whose functions and classes they name."""
    if getattr(function, "__code__", None) is None:
        return {}
    reached = _Reached()
    reached.follow(function)
    own = function.__module__
    modules = []
    for f in reached.functions:
        names = _all_names(f.__code__)
        for x in (f.__globals__.get(n) for n in names):
            if x is not None:
                modules.append(x if isinstance(x, types.ModuleType) else sys.modules.get(getattr(x, "__module__", None) or ""))
        modules += [sys.modules.get(n) for n in names]
    found: dict[str, str] = {}
    with _LOCK:
        _follow([m for m in modules if m is not None and m.__name__ != own], found)
    return found


def _all_names(code: types.CodeType) -> set[str]:
    return set(code.co_names).union(*[_all_names(c) for c in code.co_consts if isinstance(c, types.CodeType)])


#: Folders that scripts are running beside, and how many.
_BESIDE: dict[str, int] = {}


@contextmanager
def beside(path: str | None) -> Iterator[None]:
    """Modules in a script's folder can be imported while it runs, as Python itself has it; of several scripts until the last has ended."""
    folder = os.path.dirname(os.path.abspath(path)) if path else None
    with _LOCK:
        if not folder or folder in sys.path and folder not in _BESIDE:
            folder = None
        else:
            if folder not in _BESIDE:
                sys.path.insert(0, folder)
                importlib.invalidate_caches()
            _BESIDE[folder] = _BESIDE.get(folder, 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            if folder:
                _BESIDE[folder] -= 1
                if not _BESIDE[folder]:
                    del _BESIDE[folder]
                    sys.path.remove(folder)

"""What a step given as a function depends on."""

import importlib
import sys
import textwrap

import pytest

import tallyrun as t
from tallyrun import identity

MODULE = """
import math
from collections import OrderedDict as Ordered
RATE = 3
UNUSED = 1
TABLE = {"a": [1, (2, None)], "b": "x"}
LETTERS = {"p", "q"}

def inner(n):
    return n * RATE

def helper(n):
    return inner(n) + 0

def odd(n):
    return n > 0 and even(n - 1)

def even(n):
    return n == 0 or odd(n - 1)

class Scale:
    def by(self, n):
        return helper(n)

class Wide(Scale):
    @staticmethod
    def of(n):
        return math.floor(n)

def unrelated():
    return 1

def step(ctx):
    ctx.stow(Wide().by(Wide.of(1.5)) + len(TABLE["a"]) + len(LETTERS) + even(2), "n")
"""


@pytest.fixture
def store(spark, tmp_path):
    return t.Store(spark, str(tmp_path / "store"))


@pytest.fixture
def edited(tmp_path, monkeypatch):
    """Writes the module with replacements and loads it anew, as a new session would."""
    monkeypatch.syspath_prepend(str(tmp_path))

    def load(*changes, text=MODULE):
        for old, new in changes:
            assert old in text
            text = text.replace(old, new)
        (tmp_path / "tr_steps.py").write_text(text)
        sys.modules.pop("tr_steps", None)
        importlib.invalidate_caches()
        sys.dont_write_bytecode, before = True, sys.dont_write_bytecode
        try:
            return importlib.import_module("tr_steps")
        finally:
            sys.dont_write_bytecode = before

    yield load
    sys.modules.pop("tr_steps", None)


def test_edits_of_what_a_step_reaches_make_it_run(store, edited):
    status = lambda *changes: store.log.runs[store.launch(edited(*changes).step)]["status"]
    assert status() == "success" and store.grab("n") == 3 + 2 + 2 + 1
    assert status() == "skipped_fresh"
    assert status(("RATE = 3", "RATE = 6")) == "success" and store.grab("n") == 6 + 5
    for change in [("inner(n) + 0", "inner(n) + 1"), ("return n * RATE", "return n * RATE * 2"), ("(2, None)]", "(2, None), 4]"), ('{"p", "q"}', '{"p"}'), ("math.floor(n)", "math.ceil(n)"), ("return helper(n)", "return helper(n) + 5"), ("return n > 0 and", "return n >= 0 and"), ("OrderedDict as Ordered", "OrderedDict as Ordered, deque as RATE2")]:
        assert status(change) == ("success" if "deque" not in change[1] else "skipped_fresh"), change
    assert status(("UNUSED = 1", "UNUSED = 2"), ("    return 1\n", "    return 2\n")) == "skipped_fresh"


def test_recorded_functions_run_again_by_themselves(store, edited):
    """Their helpers, constants and imports are recorded with them."""
    module = edited(("LETTERS = {", "LETTERS = frozenset() or {"), ("len(LETTERS) + ", ""))
    run = store.launch(module.step, label="first")
    sys.modules.pop("tr_steps")
    again = store.launch(t.Run(run), force=True)
    assert store.log.runs[again]["status"] == "success" and store.grab("n") == 3 + 2 + 1
    code = store.launch_code(run)
    assert "RATE = 3" in code and code.index("def inner") < code.index("def helper") < code.index("def step") and "unrelated" not in code


def test_decorated_aliased_and_partial_helpers(store, edited):
    text = textwrap.dedent("""
        import functools
        STEPS = 2
        def loud(f):
            @functools.wraps(f)
            def inner(*a):
                return f(*a) + STEPS
            return inner
        @loud
        def one(n):
            return n
        two = one
        three = functools.partial(one, 4)
        four = lambda n: n + 9
        def step(ctx):
            ctx.stow(two(1) + three() + four(0), "n")
    """)
    names = [store.log.runs[store.launch(edited(*c, text=text).step)]["status"] for c in ([], [], [("STEPS = 2", "STEPS = 3")], [("return n\n", "return n + 1\n")], [("one, 4", "one, 5")], [("n + 9", "n + 8")])]
    assert names == ["success", "skipped_fresh", *["success"] * 4]


def test_modules_that_helpers_import_are_tracked(store, edited, tmp_path):
    (tmp_path / "tr_far.py").write_text("VALUE = 1\n")
    text = "import tr_far\ndef helper():\n    return tr_far.VALUE\ndef step(ctx):\n    ctx.stow(helper(), 'n')\n"
    run = store.launch(edited(text=text).step)
    assert [h["path"].rpartition("/")[2] for h in store.log.runs[run]["helpers"]] == ["tr_far.py"]
    (tmp_path / "tr_far.py").write_text("VALUE = 22\n")
    assert store.log.runs[store.launch(edited(text=text).step)]["status"] == "success" and store.grab("n") == 22
    sys.modules.pop("tr_far")


def test_functions_that_carry_themselves():
    def down(n):
        return n and down(n - 1)

    assert identity.with_values("text", down) == identity.with_values("text", down)
    assert "down" in identity.with_values("text", down)


def test_methods_carry_their_object(store):
    class Job:
        def __init__(self, n):
            self.n = n

        def run(self, ctx):
            ctx.stow(self.n, "n")

    assert identity.with_values("text", Job(1).run) != identity.with_values("text", Job(2).run)
    store.launch(Job(7).run)
    assert store.grab("n") == 7

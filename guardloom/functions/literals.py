"""Literals that a text must hold for a pattern to match, found in the pattern itself.

Searching for a plain literal is far cheaper than a regular expression, and most texts hold
none of a rule's.  The text searched is folded so that whatever the pattern's letters match
regardless of case is the small letter.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3
MOST_CHOICES = 40
#: Characters outside ASCII that match s, k or i regardless of case.
_FOLDS = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def _weaker(a: frozenset | None, b: frozenset | None) -> bool:
    """Whether ``a`` is a poorer choice than ``b``: none, shorter, or more of them."""
    if b is None or a is None:
        return a is None
    return (min(map(len, a)), -len(a)) < (min(map(len, b)), -len(b))


def _required(tree) -> tuple[frozenset | None, list[str] | None]:
    """(literals of which one must occur, all strings that the tree matches if they are few)."""
    best: frozenset | None = None
    runs: list[str] | None = [""]  # what the items just seen match, as whole strings

    def settle() -> None:
        nonlocal best
        if runs and all(len(r) >= LEAST for r in runs) and _weaker(best, frozenset(runs)):
            best = frozenset(runs)

    def cross(more: list[str] | None) -> None:
        nonlocal runs
        if more is None or len(runs) * len(more) > MOST_CHOICES:
            settle()
            runs = more if more is not None else [""]
        else:
            runs = [a + b for a in runs for b in more]

    exact = True
    for op, arg in tree:
        if op is C.LITERAL and arg < 128:
            cross([chr(arg).lower()])
        elif op is C.BRANCH:
            parts = [_required(x) for x in arg[1]]
            wholes = [p[1] for p in parts]
            if all(w is not None for w in wholes) and sum(map(len, wholes)) <= MOST_CHOICES:
                cross([s for w in wholes for s in w])
            else:
                settle()
                runs, exact = [""], False
                if all(p[0] for p in parts):
                    union = frozenset().union(*(p[0] for p in parts))
                    if len(union) <= MOST_CHOICES and _weaker(best, union):
                        best = union
        elif op is C.SUBPATTERN:
            inner, whole = _required(arg[-1])
            if whole is not None:
                cross(whole)
            else:
                settle()
                runs, exact = [""], False
                if _weaker(best, inner):
                    best = inner
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, whole = _required(body)
            if whole is not None and low == 0 and high == 1:
                cross(["", *whole])
            else:
                if low >= 1 and whole is not None:
                    cross(whole)
                settle()
                runs, exact = [""], False
                if low >= 1 and _weaker(best, inner):
                    best = inner
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            settle()
            runs, exact = [""], False
    settle()
    return best, runs if exact and runs is not None and len(runs) <= MOST_CHOICES else None


def required_literals(pattern: str) -> frozenset[str] | None:
    """Small-letter literals of which a matching text holds at least one; None if none is known."""
    readable = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    best, _ = _required(parser.parse(readable))
    if best is None or any(not x.isascii() for x in best):
        return None
    # of two literals where one holds the other, the shorter is enough
    return frozenset(x for x in best if not any(y != x and y in x for y in best))


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values())))

"""Patterns of the registry in Java's and RE2's dialects.

Java: ``d`` only newline ends a line, ``U`` Unicode classes and case, ``i`` case, ``s`` dot
takes newlines, ``m`` line anchors.  RE2 has no look-around and ASCII word boundaries, so
a boundary at either end of a pattern is written out there, and the two rules with
look-around have forms that hold of the same texts.
"""

from __future__ import annotations

INBOUND_FLAGS, OUTBOUND_FLAGS, PLAIN_FLAGS = "ism", "is", "i"

_EDGE = r"[^\p{L}\p{N}_]"
_BASE64 = "[A-Za-z0-9+/=]"
_WITHOUT_LOOKAROUND = {
    rf"(?<!{_BASE64})[A-Za-z0-9+/]{{40,}}={{0,2}}(?!{_BASE64})": rf"(?-m:(?:^|[^A-Za-z0-9+/=])[A-Za-z0-9+/]{{40,}}={{0,2}}(?:[^A-Za-z0-9+/=]|$))",
    r"\b[A-Za-z0-9/+]{40}\b(?=.*aws|.*secret)": r"\b[A-Za-z0-9/+]{40}\b.*(aws|secret)",
}


def java(pattern: str, flags: str) -> str:
    return f"(?d{flags}U){pattern}"


def re2(pattern: str, flags: str, keep_edges: bool = False) -> str:
    """For a search; with ``keep_edges`` a leading boundary is the first group, for replacing."""
    pattern = _WITHOUT_LOOKAROUND.get(pattern, pattern)
    if pattern.startswith((r"\b(", r"\bs", r"\bA", r"\bD", r"\be", r"\bS")):
        if not pattern.startswith(r"\b(\+"):
            edge = rf"(?-m:(^|{_EDGE}))" if keep_edges else rf"(?-m:^|{_EDGE})"
            pattern = edge + pattern[2:]
    if pattern.endswith(r"\b") and not keep_edges:
        pattern = pattern[:-2] + rf"(?-m:$|{_EDGE})"
    return f"(?{flags}){pattern}"

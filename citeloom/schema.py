"""Entity codes, count spaces and the algebra on them."""

from __future__ import annotations

from collections.abc import Iterable

# The codes of the entities that are counted.
ENTITIES = {
    "fa": "citing author", "ffa": "first citing author", "fj": "citing journal", "fy": "citing year",
    "c": "cited work", "ta": "cited author", "ty": "cited year", "t": "term",
    "cAge": "age of the cited work", "taAge": "age of the cited author", "ffaAge": "age of the first author", "faAge": "age of a citing author",
    "c1": "first cited work", "c2": "second cited work", "c1y": "first cited year", "c2y": "second cited year",
    "c1age": "age of the first work", "c2age": "age of the second work", "fa1": "first author of a pair", "fa2": "second author of a pair",
}

# Long names that may stand for a code.
ALIASES = {
    "citing_author": "fa", "first_citing_author": "ffa", "citing_journal": "fj", "citing_year": "fy",
    "cited_work": "c", "cited_author": "ta", "cited_year": "ty", "term": "t",
}


def entity(name: str) -> str:
    """The code of an entity given by code or long name; an unknown one is an error."""
    code = ALIASES.get(name, name)
    if code not in ENTITIES:
        raise KeyError(f"no entity {name!r}; there are {', '.join(sorted(ENTITIES))}")
    return code


def space(names: str | Iterable[str]) -> tuple[str, ...]:
    """Codes of a space in their fixed order; given as a dotted text or as names."""
    parts = names.split(".") if isinstance(names, str) else list(names)
    return tuple(sorted(entity(p) for p in parts))


def checked_space(dotted: str) -> tuple[str, ...]:
    """Codes of a dotted space that must already be in order."""
    if dotted != dotted_space(dotted):
        raise ValueError(f"space {dotted!r} is not in order: {dotted_space(dotted)!r}")
    return space(dotted)


def dotted_space(names: str | Iterable[str]) -> str:
    return ".".join(space(names))


def union_keys(*dotted: str) -> str:
    """Union of dotted keys in order: q.w.e and e.r.t give e.q.r.t.w."""
    return ".".join(sorted({k for d in dotted for k in d.split(".") if k}))

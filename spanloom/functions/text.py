"""Text predicates and scalar functions as Spark columns.

Functions of a span's surroundings take what ``attach_text`` gives: ``seg`` (the span's text), ``before`` and
``after`` (up to some characters on either side), never the whole text of a book.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import TIBETAN, Profile

MAX_WALK = 3


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def infer_batch(book: Column, given: Column | None = None, p: str = "old", i: str = "new", other: str = "unknown") -> Column:
    """Batch of a book: the given one if not blank, else by the id's first letter."""
    by_id = F.when(book.startswith("P"), p).when(book.startswith("I"), i).otherwise(other)
    return by_id if given is None else F.coalesce(F.nullif(F.trim(given), F.lit("")), by_id)


def span_text(text: Column, s: Column, e: Column) -> Column:
    """Code points [s, e) of a text. For many spans of one long text use ``attach_text``."""
    return F.substring(text, s + 1, e - s)


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def syllables(text: Column, profile: Profile = TIBETAN) -> Column:
    return F.array_remove(F.split(text, profile.syllable_sep), "")


def is_boundary(ch: Column, profile: Profile = TIBETAN) -> Column:
    return (ch != "") & (F.instr(F.lit(profile.boundary), ch) > 0)


def boundary_flags(seg: Column, before: Column, profile: Profile = TIBETAN) -> tuple[Column, Column, Column, Column]:
    """start_clean, end_clean, and the characters before the span and at its end, line breaks escaped."""
    prev, last = F.right(before, F.lit(1)), F.right(seg, F.lit(1))
    shown = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return (prev == "") | is_boundary(prev, profile), is_boundary(last, profile), shown(prev), shown(last)


def mid_syllable_flags(seg: Column, before: Column, after: Column, profile: Profile = TIBETAN) -> tuple[Column, Column]:
    """An edge is bad only if the characters on both of its sides are there and not boundaries."""
    bad = lambda a, b: (a != "") & (b != "") & ~is_boundary(a, profile) & ~is_boundary(b, profile)
    return bad(F.right(before, F.lit(1)), F.left(seg, F.lit(1))), bad(F.right(seg, F.lit(1)), F.left(after, F.lit(1)))


def snap_edges(s: Column, e: Column, seg: Column, before: Column, after: Column, profile: Profile = TIBETAN, max_walk: int = MAX_WALK) -> tuple[Column, Column, Column]:
    """New start, new end and the action: bad edges walk outwards to the nearest boundary within ``max_walk``."""
    bad_s, bad_e = mid_syllable_flags(seg, before, after, profile)
    at = lambda t, k: F.substring(t, F.lit(k + 1), F.lit(1))
    back = F.reverse(before)
    ks, ke = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in range(max_walk, 0, -1):
        ks = F.when((s == k) | is_boundary(at(back, k), profile), k).otherwise(ks)
        ke = F.when((at(after, k) == "") | is_boundary(at(after, k), profile), k).otherwise(ke)
    act_s = F.when(bad_s, F.coalesce(F.concat(F.lit("start-"), ks.cast("string")), F.lit("start_unfixed")))
    act_e = F.when(bad_e, F.coalesce(F.concat(F.lit("end+"), ke.cast("string")), F.lit("end_unfixed")))
    return F.when(bad_s, s - F.coalesce(ks, F.lit(0))).otherwise(s), F.when(bad_e, e + F.coalesce(ke, F.lit(0))).otherwise(e), F.concat_ws("|", act_s, act_e)


def heading_like(s: Column, seg: Column, before: Column, after: Column, profile: Profile = TIBETAN) -> Column:
    """An ordinal near the start, a closing particle near the end, a number, or a line of its own."""
    head = F.left(F.concat(F.right(before, F.lit(2)), seg), F.lit(14))
    tail = F.concat(F.right(seg, F.lit(4)), F.left(after, F.lit(2)))
    pre = F.right(before, F.lit(3))
    mark = profile.head_marks
    starts = (s == 0) | pre.endswith("\n") | pre.rlike(f"^[{re.escape(mark)} ]*$") | pre.endswith(f"\n{mark} ")
    alone = starts & F.left(after, F.lit(6)).rlike(rf"\A{_class(profile.shads + ' ' + chr(9) + chr(160))}*(?:\n|\z)")
    return _any(head.contains(o) for o in profile.ordinals) | tail.contains(profile.particle) | seg.rlike(profile.numbered) | alone


def opens_with_ordinal(seg: Column, profile: Profile = TIBETAN) -> Column:
    core = F.ltrim(seg, F.lit(profile.shads[0] + " "))
    return _any(core.startswith(o) for o in profile.ordinals)


def _core(seg: Column, profile: Profile) -> Column:
    bare = F.regexp_replace(seg, r"(?U)^\s+|\s+$", "")
    return F.rtrim(bare, F.lit(profile.shads + " " + profile.tsheg))


def closes_with(seg: Column, profile: Profile = TIBETAN) -> tuple[Column, Column]:
    """Whether the text, without trailing marks, ends with the particle, and with one of the second particles."""
    core = _core(seg, profile)
    return core.endswith(profile.particle), _any(core.endswith(x) for x in profile.la_particles)


def ends_with_shad(seg: Column, profile: Profile = TIBETAN) -> Column:
    return F.regexp_replace(seg, r"(?U)\s+$", "").endswith(profile.shads[0])


def ordinal_start(text: Column, profile: Profile = TIBETAN) -> Column:
    return text.rlike(profile.ordinal_start)


def punct_gap(gap: Column, profile: Profile = TIBETAN) -> Column:
    return gap.rlike(profile.gap)


def action_string(offset: Column, act: Column) -> Column:
    shift = F.when(offset != 0, F.format_string("shift%+d", offset))
    return F.coalesce(F.nullif(F.concat_ws("|", shift, F.nullif(act, F.lit(""))), F.lit("")), F.lit("keep"))


def preview(seg: Column, n: int = 80) -> Column:
    return F.replace(F.left(seg, F.lit(n)), F.lit("\n"), F.lit(" "))


def to_inclusive(e: Column) -> Column:
    return e - 1


def to_half_open(e: Column) -> Column:
    return e + 1


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of half-open spans, 0 if disjoint."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return both / ((e1 - s1) + (e2 - s2) - both)


def clauses(text: Column, profile: Profile = TIBETAN) -> Column:
    """Pieces of a text, each with its closing separator; an empty text is one empty clause."""
    sep = _class(profile.clause_seps)
    other = "[^" + sep[1:]
    pieces = F.regexp_extract_all(text, F.lit(f"{other}*{sep}|{other}+"), F.lit(0))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))


def n_syllables(clause: Column, profile: Profile = TIBETAN) -> Column:
    """Parts between syllable marks that aren't blank; the separator at the end counts as one if it stands alone."""
    return F.size(F.filter(F.split(clause, _class(profile.tsheg)), lambda x: x.rlike(r"(?U)\S")))


def convert_labels(labels: Column, scheme: str) -> Column:
    """BIO to ``io`` (B and I alike) or ``bioe`` (the last token of an entity is E); ``collapse``: 5 labels to 3.
    -100 stays."""
    if scheme == "io":
        return F.transform(labels, lambda x: F.when(x == 2, F.lit(1)).otherwise(x))
    if scheme == "collapse":
        return F.transform(labels, lambda x: F.when(x.isin(3, 4), F.lit(0)).otherwise(x))
    if scheme == "bioe":
        following = lambda i: F.coalesce(F.get(labels, i + 1), F.lit(-100))
        return F.transform(labels, lambda x, i: F.when(x.isin(1, 2) & (following(i) != 2), F.lit(3)).otherwise(x))
    return labels


def normalise_span_text(seg: Column, profile: Profile = TIBETAN) -> Column:
    """White space as one space, without head marks, leading numbers and trailing shads."""
    one = F.trim(F.regexp_replace(seg, r"(?U)\s+", " "))
    bare = F.regexp_replace(one, rf"^{_class(profile.head_marks)}+ ?", "")
    bare = F.regexp_replace(bare, profile.numbered, "")
    return F.trim(F.rtrim(bare, F.lit(profile.shads + " ")))

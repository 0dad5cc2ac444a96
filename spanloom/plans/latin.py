"""Rules for the invented Latin-script texts of the test tables, and modules whose functions take them by default."""

from __future__ import annotations

import inspect
from types import ModuleType

from ..functions.profiles import Profile

_STARTS = ("The", "And", "Die", "Der", "De", "La", "In")
LATIN = Profile(
    boundary=" \n.,!?()[]",
    syllable_sep=r"[ \n.,!]+",
    gap=r"^[ \n.,!]*$",
    clause_seps=".!",
    tsheg=" ",
    shads=".",
    head_marks="#",
    ordinals=_STARTS,
    ordinal_start=rf"^[ \n]*(?:[0-9]+[.)]? *)?(?:{'|'.join(_STARTS)})",
    anchor=rf"(?:{'|'.join(_STARTS)})[^.]{{0,200}}?on",
    particle="on",
    la_particles=("de", "er"),
    numbered=r"^[ \n]*(?:[\(\{\[] *[0-9]+ *[\)\}\]]|[0-9]+ *[\.)])",
    source_markers=("the.", "of.", "de.", "en."),
    clause_closers=("tion", "heit", "mente"),
    quote_closers=("tion", "keit", "ing"),
)


class Latin:
    """A module whose functions get the Latin profile where they take one and none is given."""

    def __init__(self, module: ModuleType):
        self._module = module

    def __getattr__(self, name: str):
        f = getattr(self._module, name)
        if not inspect.isfunction(f) or "profile" not in inspect.signature(f).parameters:
            return f
        given = lambda a, k: "profile" in k or any(isinstance(x, Profile) for x in a)
        return lambda *a, **k: f(*a, **k) if given(a, k) else f(*a, profile=LATIN, **k)

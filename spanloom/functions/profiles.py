"""Language rules of the text functions: a frozen profile for each script."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    boundary: str  # characters that may stand next to a span's edge
    syllable_sep: str  # regex of what parts syllables
    gap: str  # regex class of what may lie between neighbours
    clause_seps: str
    tsheg: str  # characters that part syllables inside a clause
    shads: str
    head_marks: str
    ordinals: tuple[str, ...]
    ordinal_start: str  # anchored regex
    anchor: str  # regex of a whole heading
    particle: str  # closes a heading
    la_particles: tuple[str, ...]
    numbered: str  # regex at a span's start
    source_markers: tuple[str, ...]
    clause_closers: tuple[str, ...]
    quote_closers: tuple[str, ...]


# Fixed values of the annotation scheme, by field: Tibetan characters, ordinals, particles, markers and patterns.
TIBETAN = Profile(
    boundary="་༌།༎༏༐༑༔༼༽༺༻[]() \t\n\r\xa0",
    syllable_sep=r"(?U)[་-༔\s]+",
    gap=r"(?U)^[\s་-༔༺-༽ ]*$",
    clause_seps="།༎༏༐༑༔",
    tsheg="་༌",
    shads="།༎",
    head_marks="༈",
    ordinals=("དང་པོ", "གཉིས་པ", "གསུམ་པ", "བཞི་པ", "ལྔ་པ", "དྲུག་པ", "བདུན་པ", "བརྒྱད་པ", "དགུ་པ", "བཅུ་པ"),
    ordinal_start=r"(?U)^[\s༈]*(?:[\(\{\[]?[0-9༠-༩]+[\)\}\]༽\.]?\s*)?(?:ད་ནི་|དེ་ནས་)?(?:དང་པོ|གཉིས་པ|གསུམ་པ|བཞི་པ|ལྔ་པ|དྲུག་པ|བདུན་པ|བརྒྱད་པ|དགུ་པ|བཅུ་པ|བཅུ་(?:གཅིག|གཉིས|གསུམ|བཞི|ལྔ|དྲུག|བདུན|བརྒྱད|དགུ)་པ|བཅོ་(?:ལྔ|བརྒྱད)་པ|ཉི་ཤུ་པ)",
    anchor="(?:དང་པོ|གཉིས་པ|གསུམ་པ|བཞི་པ|ལྔ་པ|དྲུག་པ|བདུན་པ|བརྒྱད་པ|དགུ་པ|བཅུ་པ)[^།]{0,200}?ནི",
    particle="ནི",
    la_particles=("ལ", "ལའང"),
    numbered=r"(?U)^\s*(?:[\(\{\[]\s*[0-9༠-༩]+\s*[\)\}\]]|[0-9༠-༩]+\s*[༽\.)])",
    source_markers=("གཞུང་ལས", "རྒྱུད་ལས", "ལུང་ལས", "མདོ་ལས", "ལས།", "ནས།", "ལས་"),
    clause_closers=("ཞེས་པ", "ཅེས་པ", "ཞེས་", "ཅེས་", "གསུངས"),
    quote_closers=("ཞེས་པ་སྟེ", "ཞེས་པ་ནི", "ཞེས་གསུངས", "ཅེས་གསུངས", "ཞེས་བྱ་བ", "ཞེས་པའོ", "ཞེས་པ", "ཅེས་པ", "ཞེས་", "ཅེས་"),
)

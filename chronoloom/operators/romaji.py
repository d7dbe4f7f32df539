"""Pairing of lyric lines with their romanised spelling, and the readings that follow from it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from ..functions.text import hiragana, is_odd_token

# Kana that are spelled as they sound, and how long a reading or a foreign word may be.
SOUNDS_LIKE = {"は": "[はわ]", "へ": "[へえ]", "を": "[をお]"}
KANA, LONGEST_READING, LONGEST_FOREIGN, LOOK_AHEAD = "[ぁ-ゖ]", 14, 6, 3


class LinePattern(NamedTuple):
    """What a line may sound like: as read by the dictionary, and with every kanji token left open."""

    literal: re.Pattern
    open: re.Pattern
    tokens: tuple[int, ...]  # the kanji tokens, one group each
    unsure: frozenset[int]  # those next to each other, whose border the sound doesn't tell


def _spoken(kana: str) -> str:
    return "".join(SOUNDS_LIKE.get(c, re.escape(c)) for c in kana)


def _kind(token: dict) -> str:
    if token.get("is_punct"):
        return "silent"
    if is_odd_token(token["surface"]):
        return "foreign"
    if re.search("[々㐀-鿿豈-﫿]", token["surface"]):
        return "kanji"
    return "kana" if hiragana(token["surface"]) else "silent"


def line_pattern(tokens: Sequence[dict]) -> LinePattern | None:
    """The pattern of a line of tokens (surface, reading, is_punct); None if none of them has kanji."""
    kinds = [_kind(t) for t in tokens]
    kanji = tuple(i for i, k in enumerate(kinds) if k == "kanji")
    if not kanji:
        return None
    fixed = {"silent": lambda t: "", "foreign": lambda t: f"{KANA}{{0,{LONGEST_FOREIGN}}}?", "kana": lambda t: _spoken(hiragana(t["surface"]))}
    parts = {how: "".join(fixed[k](t) if k in fixed else ((_spoken(hiragana(t.get("reading") or ""))) if how == "read" else f"({KANA}{{1,{LONGEST_READING}}}?)") for k, t in zip(kinds, tokens, strict=True)) for how in ("read", "open")}
    touching = {j for i in kanji if i + 1 < len(kinds) and kinds[i + 1] == "kanji" for j in (i, i + 1)}
    return LinePattern(re.compile(parts["read"] + "$"), re.compile(parts["open"] + "$"), kanji, frozenset(touching))


def pair_lines(lines: Sequence[Sequence[dict]], spoken: Sequence[str]) -> list[tuple[int, int | None, dict[int, str] | None]]:
    """(line, spoken line or None, readings heard) of every line with kanji, in order.

    ``spoken`` are the romanised lines in hiragana. A line goes to the first of the next three that are
    not used or passed which it fits, as read or with open readings; readings is None where it fits
    as read, else the heard reading by token.
    """
    out: list[tuple[int, int | None, dict[int, str] | None]] = []
    at = 0
    for n, tokens in enumerate(lines):
        pattern = line_pattern(tokens)
        if pattern is None:
            continue
        hit = next(((j, m) for j in range(at, min(at + LOOK_AHEAD, len(spoken))) if (m := pattern.literal.match(spoken[j]) or pattern.open.match(spoken[j]))), None)
        if hit is None:
            out.append((n, None, {}))
            continue
        j, match = hit
        at = j + 1
        out.append((n, j, None if match.re is pattern.literal else dict(zip(pattern.tokens, match.groups(), strict=True))))
    return out

"""Splitting one document into overlapping chunks (the per-row helper of T1).

Three steps, each over numbers where it can be: the split gives units with their
places, the lengths of the units decide where chunks begin, and the chunk texts
are put together from those borders.
"""

import re
from collections.abc import Iterable

from matterlake import schemas as S
from matterlake.functions.text import BLANK, BLANKS

_PARAGRAPH_GAP = re.compile(r"\n{2,}|\Z")
_SENTENCE = re.compile("[^.!?]+([.!?]++(?:" + BLANK + r"|\Z))?")
_SENTENCE_END = re.compile("(?<=[.!?]" + BLANK + r")|\Z")
_JOINT = "\n\n"

# (place in the text, unit text)
Unit = tuple[int, str]


def _between(marks: Iterable[re.Match]) -> list[tuple[int, int]]:
    """The non-empty stretches between ascending matches."""
    out, edge = [], 0
    for m in marks:
        if m.start() > edge:
            out.append((edge, m.start()))
        edge = m.end()
    return out


def _starts(lengths: list[int], limit: int, joint: int = 0, carried: int = 0) -> list[int]:
    """Which pieces begin a group, when a group takes pieces while they fit.

    A group after the first begins with up to ``carried`` characters of the one
    before it; ``joint`` characters stand between pieces.
    """
    starts: list[int] = []
    size = 0
    for piece, n in enumerate(lengths):
        if not starts or size + joint + n > limit:
            size = min(size, carried) if starts else 0
            starts.append(piece)
            size += joint if size else 0
        else:
            size += joint
        size += n
    return starts


def _groups(starts: list[int], n: int) -> list[slice]:
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], n])]


def _stripped(at: int, text: str) -> Unit:
    bare = text.lstrip(BLANKS)
    return at + len(text) - len(bare), bare.rstrip(BLANKS)


def _packs(paragraph: str, lossy: bool) -> list[Unit]:
    """A long paragraph as packs of sentences."""
    if lossy:
        found = [m.span() for m in _SENTENCE.finditer(paragraph) if m.group(1)]
    else:
        found = _between(_SENTENCE_END.finditer(paragraph))
    found = found or [(0, len(paragraph))]
    lengths = [b - a for a, b in found]
    packs = _groups(_starts(lengths, S.SENTENCE_PACK_CHARS), len(found))
    return [
        _stripped(found[p][0][0], "".join(paragraph[a:b] for a, b in found[p]))
        for p in packs
    ]


def _units(text: str, lossy: bool) -> list[Unit]:
    """Paragraphs; those above the packing limit as packs of sentences."""
    out: list[Unit] = []
    for a, b in _between(_PARAGRAPH_GAP.finditer(text)):
        at, paragraph = _stripped(a, text[a:b])
        if len(paragraph) <= S.SENTENCE_PACK_CHARS:
            out.append((at, paragraph))
        else:
            out += [(at + offset, pack) for offset, pack in _packs(paragraph, lossy)]
    return [u for u in out if u[1]]


def _lossy_places(text: str, units: list[Unit]) -> list[Unit]:
    """A pack with text dropped inside is not in the text: it follows its predecessor."""
    out: list[Unit] = []
    for _, unit in units:
        end = out[-1][0] + len(out[-1][1]) if out else 0
        out.append((max(end, text.find(unit, end)), unit))
    return out


def chunk_text(content: str, lossy: bool = False) -> list[tuple[str, int, int]]:
    """[(text, start, end)] with offsets into the trimmed text."""
    text = content.replace("\r\n", "\n").strip(BLANKS)
    units = _units(text, lossy)
    if lossy:
        units = _lossy_places(text, units)
    starts = _starts(
        [len(u) for _, u in units],
        S.CHUNK_TARGET_CHARS,
        len(_JOINT),
        S.CHUNK_OVERLAP_CHARS,
    )
    chunks: list[tuple[str, int, int]] = []
    for group in _groups(starts, len(units)):
        overlap = chunks[-1][0][-S.CHUNK_OVERLAP_CHARS :] + _JOINT if chunks else ""
        whole = overlap + _JOINT.join(u for _, u in units[group])
        start = units[group][0][0] - len(overlap)
        chunks.append((whole, start, start + len(whole)))
    return chunks

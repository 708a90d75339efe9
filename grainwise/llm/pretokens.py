"""Splitting text before byte-level merges: a deterministic transducer run over chunks in parallel.

The pattern of ``public_tokenizers.PATTERN`` is compiled to a transducer over twelve character classes. Its look-ahead
is one character, so a transition says whether a token starts at the character read, and whether one started at the
character before. A slice of text is cut into chunks; each chunk's map from entry state to exit state is computed for
all states at once, the maps are composed by a parallel prefix scan, and a last pass from the known entry states emits
the token starts. Texts are separated by an end mark that brings every state back to the start.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

END, LETTER, STMD, R, V, EL, E, NUMBER, APOSTROPHE, OTHER, BLANK, SPACE = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK_1, BLANK_N, SPACE_1, SPACE_N, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
CHUNK = 192


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Character class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        table[found] = kind
    for text, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", EL), ("e", E), ("'", APOSTROPHE), (" ", BLANK)):
        for c in text:
            table[ord(c)] = kind
    return table


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class; output bit 1: a token starts here, bit 2: one started a character ago."""
    step = np.zeros((12, 12), np.uint8)
    out = np.zeros((12, 12), np.uint8)
    letters = (LETTER, STMD, R, V, EL, E)
    fresh = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTE, BLANK: BLANK_1, SPACE: SPACE_1, END: START} | dict.fromkeys(letters, IN_LETTERS)

    def set_(state: int, kind: int, to: int, emit: int) -> None:
        step[state, kind], out[state, kind] = to, emit

    def begin(state: int, kind: int, extra: int = 0) -> None:
        """A token starts at this character (the end mark starts none)."""
        set_(state, kind, fresh[kind], extra | (kind != END))

    for state in range(12):
        for kind in range(12):
            begin(state, kind)
    for kind in letters:
        set_(IN_LETTERS, kind, IN_LETTERS, 0)
    set_(IN_NUMBERS, NUMBER, IN_NUMBERS, 0)
    for kind in (OTHER, APOSTROPHE):
        set_(IN_OTHERS, kind, IN_OTHERS, 0)
        set_(QUOTE, kind, IN_OTHERS, 0)
    # White space: the last character of a run before other text stands apart; a blank there goes with what follows.
    for one, many, joins in ((BLANK_1, BLANK_N, True), (SPACE_1, SPACE_N, False)):
        for state, apart in ((one, 0), (many, 2)):
            set_(state, BLANK, BLANK_N, 0)
            set_(state, SPACE, SPACE_N, 0)
            set_(state, END, START, 0)
            for kind in (*letters, NUMBER, OTHER, APOSTROPHE):
                if joins:
                    set_(state, kind, IN_OTHERS if kind == APOSTROPHE else fresh[kind], apart)
                else:
                    begin(state, kind, apart)
    # Contractions after an apostrophe that starts a token.
    set_(QUOTE, STMD, START, 0)
    for kind, state, last in ((R, QUOTE_R, E), (V, QUOTE_V, E), (EL, QUOTE_L, EL)):
        set_(QUOTE, kind, state, 0)
        for after in range(12):
            if after in letters:
                set_(state, after, IN_LETTERS, 2)
            else:
                begin(state, after, 2)
        set_(state, last, START, 0)
    return step, out


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (one row each), by doubling."""
    maps = maps.copy()
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return maps


def run(classes: np.ndarray) -> np.ndarray:
    """Outputs of the transducer over one class sequence that begins at a text start."""
    step, out = transducer()
    n = len(classes)
    width = min(CHUNK, max(1, n))
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp)
    flat_step, flat_out = step.ravel(), out.ravel()
    maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
    for t in range(width):
        maps = flat_step[maps.astype(np.intp) * 12 + grid[t][:, None]]
    entry = np.zeros(rows, np.intp)
    entry[1:] = scan(maps)[:-1, START]
    emitted = np.empty((width, rows), np.uint8)
    for t in range(width):
        at = entry * 12 + grid[t]
        emitted[t] = flat_out[at]
        entry = flat_step[at].astype(np.intp)
    return emitted.T.ravel()[:n]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of texts given as UTF-8 bytes: (byte starts, byte ends, text index)."""
    n = len(offsets) - 1
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    text_of = np.searchsorted(offsets, lead, "right") - 1
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    place = np.arange(len(points)) + np.searchsorted(full, text_of)  # one end mark before each further text
    classes = np.full(len(points) + len(full), END, np.uint8)
    classes[place] = class_table()[points]
    emitted = run(classes)
    starts = (emitted & 1).astype(bool)
    starts[:-1] |= (emitted[1:] & 2) > 0
    starts = lead[starts[place]]
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    return starts, np.minimum(ends, offsets[1:][text]), text

"""The best window of a page's lines for a text: exact, with bounds that spare most of the comparing."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np

from parchment.functions.fuzzy import WORD, partial_ratio, places, ratio, rounded

STRIDE = 6  # of starts that are compared before all others


@lru_cache(maxsize=256)
def scores(n: int) -> np.ndarray:
    """Score of a text of n characters against a part: by common characters and the part's length."""
    return np.array([[rounded(200.0 * k / (n + size)) if k <= size else 0.0 for size in range(n + 1)] for k in range(n + 1)])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for each i."""
    till = np.cumsum(count)
    return np.repeat(first - till + count, count) + np.arange(till[-1] if len(till) else 0)


class Pages:
    """Texts of one length n and a page of lines for each, laid end to end.

    A page's text is its lines joined by spaces; between pages stand n blanks, which meet nothing. `line_*` has the
    lines with text of all pages: their pair, number on the page, and first and last place.
    """

    def __init__(self, needles: list[str], pages: list[list[str]]):
        self.n = n = len(needles[0])
        blanks, parts, at = "\0" * n, [], n
        pair, no, start, end = [], [], [], []
        self.page_start, self.page_end = np.zeros((2, len(pages)), np.int64)
        for i, lines in enumerate(pages):
            self.page_start[i] = at
            for k, line in enumerate(lines):
                if line:
                    pair.append(i), no.append(k), start.append(at), end.append(at + len(line))
                    at += len(line) + 1
            text = " ".join(x for x in lines if x)
            self.page_end[i] = self.page_start[i] + len(text)
            at = int(self.page_end[i]) + n
            parts.append(text)
        self.pair, self.no, self.start, self.end = (np.array(x, np.int64) for x in (pair, no, start, end))
        whole = np.frombuffer((blanks + blanks.join(parts) + blanks).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct: dict[str, int] = {}
        which = np.array([distinct.setdefault(x, len(distinct)) for x in needles])
        letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(distinct))))}
        code = np.zeros(int(max(whole.max(initial=0), *map(ord, letters))) + 1, np.int64)
        code[[ord(c) for c in letters]] = list(letters.values())
        owner = np.repeat(which, np.diff(np.concatenate([[0], self.page_start[1:], [len(whole)]])))
        self.masks = []
        for turned in (False, True):
            table = np.zeros((len(distinct), len(letters) + 1), np.uint64)
            for needle, i in distinct.items():
                for c, mask in places(needle[::-1] if turned else needle).items():
                    table[i, letters[c]] = mask
            self.masks.append(table[owner, code[whole]])
        self.calls = 0

    def steps(self, at: np.ndarray, step: int):
        """Common characters of the text and the 1, 2, ... n characters from each place on, forwards or backwards."""
        full = np.uint64((1 << self.n) - 1)
        row, masks = np.full(len(at), full), self.masks[step < 0]
        self.calls += len(at)
        for t in range(self.n):
            met = row & masks[at + t * step]
            row = (row + met | row - met) & full
            yield row

    def common(self, at: np.ndarray) -> np.ndarray:
        """Common characters of the text and the n characters from each place on."""
        row = np.zeros(0, np.uint64)
        for row in self.steps(at, 1):
            pass
        return self.n - np.bitwise_count(row).astype(np.int64)

    def table(self, at: np.ndarray, step: int) -> np.ndarray:
        """common for every length from 0 to n."""
        return np.stack([np.zeros(len(at), np.int64), *(self.n - np.bitwise_count(row).astype(np.int64) for row in self.steps(at, step))], 1)


def best_of_length(needles: list[str], pages: list[list[str]], most: int, calls: Counter) -> list[list[tuple[int, int, float]]]:
    """For texts of one length: the windows (first line, lines, score) of each page that may be the best, all with its best score.

    Every window's score is that of a part of its text: a slice of n characters, or a shorter one at its start or its end, or
    the whole of a window shorter than n. Windows share lines, so parts belong to the page, each to the smallest window
    that has it; shorter ones are read off one pass from each line's start and each line's end. Of the slices every
    STRIDE-th is compared first. A slice moved by one character gains at most one common character, which bounds
    the others; only those that can reach the best so far are compared.
    """
    p, n, out = Pages(needles, pages), len(needles[0]), []
    score, lines = scores(n), len(p.no)
    found: list[tuple[np.ndarray, ...]] = []  # (pair, first, size, score)
    if lines:
        forward, backward = p.table(p.start, 1), p.table(p.end - 1, -1)
        lengths = np.arange(n + 1)
        ahead, behind = (score[x, lengths][:, :n].max(1) for x in (forward, backward))
        first = np.arange(lines)
        last = np.searchsorted(p.end, p.start + n)
        begun = np.searchsorted(p.start, p.end - n, "right") - 1
        for a, b, value in ((first, last, ahead), (begun, first, behind)):
            held = (a >= 0) & (b < lines)
            a, b, value = a[held], b[held], value[held]
            held = (p.pair[a] == p.pair[b]) & (p.no[b] - p.no[a] < most)
            a, b = a[held], b[held]
            found.append((p.pair[a], p.no[a], p.no[b] - p.no[a] + 1, value[held]))
        same = []
        for d in range(min(most, lines)):
            a, b = first[: lines - d], first[d:]
            size, length = p.no[b] - p.no[a] + 1, p.end[b] - p.start[a]
            held = (p.pair[a] == p.pair[b]) & (size <= most) & (length <= n)
            a, b, size, length = a[held], b[held], size[held], length[held]
            whole = length < n
            found.append((p.pair[a[whole]], p.no[a[whole]], size[whole], score[forward[a[whole], length[whole]], length[whole]]))
            same += zip(a[~whole].tolist(), size[~whole].tolist(), strict=True)
    best = np.zeros(len(pages))
    for pair, _, _, value in found:
        np.maximum.at(best, pair, value)

    count = np.maximum(p.page_end - p.page_start - n + 1, 0)
    at = spread(p.page_start, count)
    if len(at):
        pair = np.repeat(np.arange(len(pages)), count)
        offset = at - p.page_start[pair]
        a, b = np.searchsorted(p.start, at, "right") - 1, np.searchsorted(p.end, at + n - 1, "right")
        size = p.no[b] - p.no[a] + 1
        known = (offset % STRIDE == 0) | (offset == count[pair] - 1)
        value = np.zeros(len(at), np.int64)
        value[known] = p.common(at[known])
        held = known & (size <= most)
        np.maximum.at(best, pair[held], score[value[held], n])
        where = np.flatnonzero(known)
        left, right = where[np.searchsorted(where, np.arange(len(at)), "right") - 1], where[np.searchsorted(where, np.arange(len(at)))]
        reach = np.minimum(value[left] + np.arange(len(at)) - left, value[right] + right - np.arange(len(at)))
        reach = np.minimum(np.where(known, value, reach), n)
        more = ~known & (size <= most) & (score[reach, n] >= best[pair])
        value[more] = reach[more] = p.common(at[more])
        held = (known | more) & (size <= most)
        found.append((pair[held], p.no[a[held]], size[held], score[value[held], n]))
        np.maximum.at(best, pair[held], score[value[held], n])
        for line, lines_held in same if lines else ():  # as long as the text: parts of the text against it count, too
            i = int(p.pair[line])
            bound = int(reach[np.searchsorted(at, p.start[line])])
            if rounded(200.0 * bound / (n + bound)) >= best[i]:
                begin = int(p.no[line])
                exact = rounded(partial_ratio(needles[i], " ".join(x for x in pages[i][begin : begin + lines_held] if x)))
                calls["windows"] += 1
                best[i] = max(best[i], exact)
                found.append((np.array([i]), np.array([begin]), np.array([lines_held]), np.array([exact])))
    calls["parts"] += p.calls
    if not found:
        return [[] for _ in pages]
    pair, first, size, value = (np.concatenate(x) for x in zip(*found, strict=True))
    top = np.flatnonzero((value == best[pair]) & (value > 0))
    out = [[] for _ in pages]
    for i, a, k, v in zip(pair[top].tolist(), first[top].tolist(), size[top].tolist(), value[top].tolist(), strict=True):
        out[i].append((a, k, v))
    return out


def best_of_long(needle: str, lines: list[str], most: int, calls: Counter) -> list[tuple[int, int, float]]:
    """The same for a text of over WORD characters: window by window, those with the most of its letters first, until none can be better."""
    bag, n, asked = Counter(needle), len(needle), []
    for a in range(len(lines)):
        held: Counter = Counter()
        text = ""
        for size in range(1, min(most, len(lines) - a) + 1):
            line = lines[a + size - 1]
            if not line:
                continue
            held.update(line + " " * bool(text))
            text = f"{text} {line}" if text else line
            if lines[a]:
                common = (bag & held).total()
                asked.append((200.0 * common / (n + (common if len(text) >= n else len(text))), a, size, text))
    best, found = 0.0, []
    for bound, a, size, text in sorted(asked, key=lambda x: -x[0]):
        if rounded(bound) < best:
            break
        calls["windows"] += 1
        value = rounded(partial_ratio(needle, text) if len(text) >= n else ratio(needle, text))
        best = max(best, value)
        found.append((a, size, value))
    return [x for x in found if x[2] == best and best > 0]


def best_windows(needles: list[str], pages: list[list[str]], tops: list[list[float]], bottoms: list[list[float]], most: int, calls: Counter | None = None) -> list[tuple[int, int, float] | None]:
    """(first line, lines, score) of the window of up to `most` lines of its page that fits each text best; None if nothing fits.

    The highest score to one decimal wins, then the smallest window, then the one whose box has the highest centre, then the
    first. `pages` has normalised lines; `tops` and `bottoms` their boxes' edges. `calls` counts what was compared.
    """
    calls = Counter() if calls is None else calls
    out: list = [None] * len(needles)
    lengths: dict[int, list[int]] = {}
    for i, needle in enumerate(needles):
        lengths.setdefault(len(needle), []).append(i)
    for n, rows in lengths.items():
        if n > WORD:
            found = [best_of_long(needles[i], pages[i], most, calls) for i in rows]
        else:
            found = best_of_length([needles[i] for i in rows], [pages[i] for i in rows], most, calls) if n else [[] for _ in rows]
        for i, held in zip(rows, found, strict=True):
            if held:
                least = min(k for _, k, _ in held)
                tied = {x for x in held if x[1] == least}
                out[i] = min(tied, key=lambda x: ((min(tops[i][x[0] : x[0] + x[1]]) + max(bottoms[i][x[0] : x[0] + x[1]])) / 2, x[0])) if len(tied) > 1 else tied.pop()
    return out

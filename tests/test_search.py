"""The bounded search for the best window against every window, and how much it spares."""

import random
from collections import Counter

import pytest

from parchment.functions.fuzzy import partial_ratio, ratio, rounded
from parchment.functions.search import best_windows, scores
from parchment.operators import match


def every_window(needle, lines, tops, bottoms, most):
    """The best window by trying all, and how many parts of texts that takes."""
    best, parts = None, 0
    for a in range(len(lines)):
        for size in range(1, min(most, len(lines) - a) + 1):
            text = " ".join(x for x in lines[a : a + size] if x)
            if text:
                parts += len(text) + len(needle) - 1 if len(text) >= len(needle) else 1
                score = rounded(partial_ratio(needle, text) if len(text) >= len(needle) else ratio(needle, text))
                key = (score, -size, -(min(tops[a : a + size]) + max(bottoms[a : a + size])) / 2, -a)
                if score > 0 and (best is None or key > best[0]):
                    best = key, (a, size, score)
    return best and best[1], parts


@pytest.mark.parametrize("seed", range(6))
def test_same_window_as_trying_all(seed):
    rng = random.Random(seed)
    for _ in range(40):
        letters = rng.choice(["ab", "abc ", "abcdefghij klmnop", "xyzé日 "])

        def text(n, letters=letters):
            return " ".join("".join(rng.choice(letters) for _ in range(n)).split())

        needles, pages, tops = [], [], []
        for _ in range(rng.randrange(1, 8)):
            needle = text(rng.choice([4, 5, 8, 12, 20, 63, 64, 65, 80])) or "a"
            lines = [text(rng.randrange(rng.choice([3, 15, 40]))) for _ in range(rng.randrange(9))]
            if lines and rng.random() < 0.4:
                lines[rng.randrange(len(lines))] = needle[: rng.randrange(len(needle) + 1)].strip()
            needles.append(needle), pages.append(lines), tops.append([rng.choice([0.0, 20.0, i * 20.0]) for i in range(len(lines))])
        bottoms, most = [[y + 16 for y in x] for x in tops], rng.choice([1, 2, 6])
        want = [every_window(*x, most)[0] for x in zip(needles, pages, tops, bottoms, strict=True)]
        assert best_windows(needles, pages, tops, bottoms, most) == want


def test_a_tenth_of_the_comparing_is_left():
    rng = random.Random(4)
    words = ["total", "street", "invoice", "amount", "garden", "machine", "ltd", "road", "green", "paper", "number", "12.50", "7", "2019"]
    pages = [[" ".join(rng.choice(words) for _ in range(rng.randrange(2, 7))) for _ in range(12)] for _ in range(60)]
    needles = [" ".join(rng.choice(words) for _ in range(4)) for _ in pages]
    tops = [[20.0 * i for i in range(12)] for _ in pages]
    bottoms, calls = [[y + 16 for y in x] for x in tops], Counter()
    got = best_windows(needles, pages, tops, bottoms, 6, calls)
    want, parts = zip(*(every_window(*x, 6) for x in zip(needles, pages, tops, bottoms, strict=True)), strict=True)
    assert got == list(want)
    assert calls["parts"] * 10 < sum(parts) and calls["windows"] < len(pages)


def test_empty_pages_and_texts():
    assert best_windows(["abcd", "abcd", "abcd", ""], [[], ["", ""], ["zz"], ["abcd"]], [[], [0.0, 0.0], [0.0], [0.0]], [[], [1.0, 1.0], [1.0], [1.0]], 6) == [None] * 4
    assert best_windows([], [], [], [], 6) == []
    assert scores(4)[3, 4] == 75.0


def test_texts_across_lines_and_pages(spark):
    box = "named_struct('x0', 0D, 'y0', 20D * n, 'x1', 9D, 'y1', 20D * n + 16, 'page', p) AS box"
    rows = [(1, 0, 0, "Grand  Hotel"), (1, 0, 1, " of the"), (1, 0, 2, "North Sea"), (1, 1, 3, "Grand Hotel of the Nord Sea"), (2, 0, 0, ""), (2, 0, 1, "nothing like it")]
    lines = spark.createDataFrame(rows, "doc_id long, p int, n int, text string").selectExpr("doc_id", "p AS page", "n AS line_no", "text", box)
    fields = spark.createDataFrame([(i, None, "vendor_name", "text", "Grand Hotel of the North Sea", None, None) for i in (1, 2, 3)], "doc_id long, item_no int, field string, kind string, value string, value_num double, value_date date")
    best = {r.doc_id: r.best for r in match.best_window(match.score_texts(fields, lines)).collect()}
    assert (best[1].score, best[1].text, best[1].box.y0, best[1].box.y1) == (100.0, "Grand  Hotel  of the North Sea", 0.0, 56.0)
    assert 0 < best[2].score < 70 and 3 not in best

"""Windows over a document's outline against their definitions, and the cases they are made for."""

import random

import pytest
from prosewright.operators import context
from prosewright.operators.context import LIST_ITEM, Outline


def document(rng, n):
    make = ["", "text", "- item", "  - inner", "    1. deep", "| a | b |", "# one", "## two", "### three", "```", "   more"]
    weights = rng.choice([[3, 3, 2, 2, 1, 2, 1, 1, 1, 1, 2], [0, 1, 6, 6, 4, 0, 0, 0, 0, 0, 3], [1, 1, 0, 0, 0, 20, 1, 1, 0, 0, 0]])
    return rng.choices(make, weights, k=n)


def slow_blocks(lines):
    """Blank lines part blocks, but those between an odd fence and the next one do not."""
    fences = [i for i, r in enumerate(lines) if r.lstrip().startswith("```")]
    inside = lambda i: sum(f <= i for f in fences) % 2 == 1
    full = [bool(r.strip()) or inside(i) for i, r in enumerate(lines)]
    starts = [i for i, f in enumerate(full) if f and (i == 0 or not full[i - 1])]
    return [(s + 1, next((i for i in range(s, len(lines)) if not full[i]), len(lines))) for s in starts]


def slow_chain(lines, n):
    """Headings above that no heading between them and the line outranks or equals; the nearest always."""
    level = {i + 1: len(r.split()[0]) for i, r in enumerate(lines) if r.startswith("#")}
    above = [h for h in level if h < n]
    return {h for h in above if all(level[h] < level[k] for k in above if k > h)}


def slow_window(lines, n, budget):
    dent = lambda k: len(lines[k - 1]) - len(lines[k - 1].lstrip())
    blocks, heads = slow_blocks(lines), slow_chain(lines, n)
    mine = [i for i, (a, b) in enumerate(blocks) if a <= n <= b]
    if not mine:
        return heads | ({n - 1, n, n + 1} & set(range(1, len(lines) + 1)))
    a, b = blocks[mine[0]]
    out = heads | set(range(a, b + 1))
    if len(out) > budget:
        items = [k for k in range(a, b + 1) if LIST_ITEM.match(lines[k - 1])]
        if 2 * len(items) >= b - a + 1:
            start = max([k for k in items if k <= n], default=a)
            out = heads | {k for k in range(start, b + 1) if not any(start < j <= k and dent(j) <= dent(start) for j in items)}
            out |= {k for k in items if k < start and start in items and all(dent(k) < dent(j) for j in items if k < j <= start)}
            out |= {a} if a not in items else set()
        elif all(lines[k - 1].startswith("|") for k in range(a, b + 1)):
            out = heads | {k for k in range(a, b + 1) if k - a < 2 or abs(k - n) <= 2}
        else:
            return None
        if len(out) > budget:
            return None
    for i in (mine[0] - 1, mine[0] + 1):
        if 0 <= i < len(blocks) and len(out | set(range(blocks[i][0], blocks[i][1] + 1))) <= budget:
            out |= set(range(blocks[i][0], blocks[i][1] + 1))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_windows_are_what_their_definition_says(seed):
    rng = random.Random(seed)
    lines = document(rng, rng.randint(1, 60))
    tree = Outline(lines)
    assert tree.blocks == slow_blocks(lines)
    for n in range(1, len(lines) + 1):
        assert tree.chain(n) == slow_chain(lines, n)
        for budget in (4, 9, 20, 200):
            assert tree.window(n, budget) == slow_window(lines, n, budget), (n, budget, lines)


def frame(spark, texts):
    return spark.createDataFrame([(d, i, r) for d, t in texts.items() for i, r in enumerate(t, 1)], "doc_key string, line_no int, text string")


def test_long_tables_lists_and_paragraphs(spark):
    table = ["# Head", "", "| a |", "|---|"] + [f"| {i} |" for i in range(300)]
    items = ["Lead:"] + [f"{'  ' * (i % 3)}- {i}" for i in range(300)]
    prose = ["word"] * 300
    lines = frame(spark, {"table": table, "list": items, "prose": prose})
    targets = spark.createDataFrame([("table", 150), ("list", 151), ("prose", 150), ("prose", None), ("prose", 999), ("none", 1)], "doc_key string, line_no int")
    got = {r.doc_key: (r.line_no, r.shown, r.fallback) for r in context.block_windows(targets, lines).collect()}
    assert got == {"table": (150, [1, 3, 4, 148, 149, 150, 151, 152], False), "list": (151, [1, 149, 150, 151], False), "prose": (150, None, True)}
    fixed = {r.doc_key: r.shown for r in context.fixed_windows(targets, lines).collect()}
    assert fixed["table"] == [1, 3, 4, *range(130, 171)] and fixed["prose"] == list(range(130, 171))
    assert context.block_windows(targets.limit(0), lines).count() == 0 == context.block_windows(targets, lines.limit(0)).count()


def test_headings_of_visible_html_lines(spark):
    lines = frame(spark, {"d": ["Title", "", "Part", "", "text"]})
    heads = spark.createDataFrame([("d", 1, 1), ("d", 3, 2)], "doc_key string, line_no long, level int")
    targets = spark.createDataFrame([("d", 5)], "doc_key string, line_no int")
    assert context.block_windows(targets, lines, 3, heads).collect()[0].shown == [1, 3, 5]
    assert context.block_windows(targets, lines, 2, heads).collect()[0].fallback

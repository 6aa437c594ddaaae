"""The filter audit against a walk of every document through every order."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from tallywright.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string, n long"
LABELS = "doc_id long, quality int, toxic int, part string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t, _ in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(Counter)
    for i, text, lang, *_ in docs:
        t, part = text or "", lang or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and t in least and least[t] < i,
        }
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                at = out[part, "".join(order), k]
                now = fails[f] and not gone
                at["removed"] += now
                at["redundant"] += fails[f] and gone
                at["unique_fails"] += fails[f] and sum(fails.values()) == 1
                at["good_lost"] += now and good[i]
                at["toxic_lost"] += now and toxic[i]
                gone = gone or fails[f]
                at["kept"] += not gone
    total = Counter()
    for (part, order, k), at in out.items():
        total[part, order[k - 1]] += at["removed"]
    return {(p, o, k): tuple(int(at[c]) if c != "shapley" else total[p, o[k - 1]] for c in COLUMNS) for (p, o, k), at in out.items()}


def audited(spark, docs, labels):
    cells = filter_audit.mask_cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(cells).collect()}


def test_all_orders_against_a_walk(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)] + ["Über", "ÀÉ", "A", "BCD", "x|y", "50%", "tab\x0bin", "no\x85break"]
    texts = [None, "", " \t\r\n", "one", "A" * 50, "é" * 33 + "A", "é" * 32 + "A"]
    texts += [" ".join(rng.choices(words[: rng.choice([60, 100, 408])], k=rng.choice([150, 199, 200, 201, 260]))) for _ in range(60)]
    texts += ["\n".join(["same line " * 30] * 9), " ".join(f"u{k}" for k in range(200))]
    docs = [(rng.randrange(400), rng.choice(texts), rng.choice(["en", "de", None, ""]), "x", 7) for _ in range(300)]
    docs += docs[:20] + [(None, t, "en", None, None) for t in texts[:9]] + [(5, texts[10], "en", "", 0), (5, texts[10], "de", "", 0), (5, texts[11], "de", "", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "clash") for i in range(0, 500, 2)]
    labels += [(4, 1, 0, ""), (4, 0, 1, ""), (None, 1, 1, "")]
    got, want = audited(spark, docs, labels), brute(docs, labels)
    assert len(got) == 3 * 600 and got == want


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    got = audited(spark, [(1, None, None, "", 0)], [])
    assert len(got) == 600 and got["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 5] == (0, 0, 0, 0, 0, 0, 0)


def test_a_common_text_is_not_gathered(spark):
    """Of one text with a third of all rows, a row per task is what is left after the tasks' own minimum."""
    rows = 30_000
    docs = spark.range(rows).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text", "'en' AS lang")
    labels = spark.createDataFrame([], LABELS)
    cells = {r["mask"]: r["n"] for r in filter_audit.mask_cells(docs, labels).collect()}
    assert cells == {"A": rows - rows // 3 + 1, "AE": rows // 3 - 1}

"""Quality measurements against a plain count, and policies against their rules."""

import re

from kinloom.llm import quality as Q

TEXTS = [
    None, "", "   \n\t", "one two", "a b c d e", "a b c d e a b c d e", "x " * 40, "w1 w2 w3 w4 w5 w6\nw1 w2 w3 w4 w5 w6\n\n  \n", "the***quick ### $$$ <b> | & %", "a b c d e f a b c d e g b c d e f",
    "é ü\u00a0ñ \x0b\x0c z", "#" * 50 + " tail", "line\nline\n line\nline ", "x" * 5000, " ".join(f"t{i % 701}" for i in range(5000)),
]


def _plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def _ledger(spark):
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words string, x0 int")
    return Q.ledger(df)


def test_measurements(spark):
    for r in _ledger(spark).collect():
        n = _plain(TEXTS[r.doc_id % len(TEXTS)])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == n
        fails = (n[0] < 10, 100 * n[5] > 20 * n[0], 100 * n[4] > 50 * n[3], n[2] > n[0], n[1] > 20 * n[0])
        assert r.fail_bits == sum(f << i for i, f in enumerate(fails))
        assert r.x0 == 7


def test_policies_and_ablations(spark):
    entries = Q.with_policy(_ledger(spark), "v1").cache()
    rows = entries.collect()
    assert all(r.kept == (r.fail_bits & Q.policy_mask("v1") == 0) for r in rows)
    for r in Q.ablations(entries).collect():
        mask, bit = Q.policy_mask(r.policy), Q.BIT[r.rule]
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only_this == sum(x.fail_bits & mask == bit for x in rows)
        assert r.n_rejected == sum(bool(x.fail_bits & mask) for x in rows)


def test_empty(spark):
    assert Q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0

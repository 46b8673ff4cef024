import random
import re
from collections import Counter

from lattica.llm import quality_rules as q
from lattica.llm.textblock import TextBlock

TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "a b c d e f g a b c d e x y z",
    "line one\nline one\n\nline two\nline one \n  \nline one",
    "é ü ñ x # * $ % & | < > \x85 a\x1cb",
    "spam ham eggs toast tea " * 40,
    "THE WHOLE TEXT IS IN CAPITALS!! AND SHOUTS!! ALL THE TIME!! EVERY WORD!!",
    "x" * 50_000 + "\n" + "word " * 3000,
    "the end",
    "the end",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measurements_equal_brute_force():
    m = q.measure(TextBlock.of(TEXTS))
    got = list(zip(*(m[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_ledger_policy_and_ablation(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fail_bits string")
    rows = q.apply_policy(q.ledger(docs), "v1").orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS)
    for r, t in zip(rows, TEXTS, strict=True):
        n, _, _, _, rep = brute(t)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    full = q.ledger(docs)
    ab = {r.rule: r for r in q.ablations(full, "v1").collect()}
    assert ab["few_words"].n_failed == sum(brute(t)[0] < 10 for t in TEXTS)
    assert q.ledger(docs.limit(0)).count() == 0


def test_keep_follows_the_ledger_under_each_policy(spark):
    texts = [None, "", "too few words", "plain words that say something about nothing much at all today", "### " * 30 + "a b c d e f g h i j", "1234567 " * 12 + "a b c d e f g h", "AB " * 4 + "LOUD WORDS EVERYWHERE IN THIS SHORT TEXT OF MINE"]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, fail_bits int")
    for policy in q.POLICIES:
        want = {r.doc_id for r in q.apply_policy(q.ledger(docs), policy).filter("kept").collect()}
        got = q.keep(docs, policy)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
        assert {r.fail_bits for r in got.collect()} <= {-1}
    v1, v2 = ({r.doc_id for r in q.keep(docs, p).collect()} for p in ("v1", "v2"))
    assert 3 in v2 and v2 <= v1


def test_ablations_equal_counting(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["word", "###", "12345678", "LOUD", "a", "!!", "\n"], k=rng.randint(3, 60))) for _ in range(120)]
    led = q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bits = [r.fail_bits for r in led.collect()]
    for policy, mask in q.POLICIES.items():
        for r in q.ablations(led, policy).collect():
            bit = q.BIT[r.rule]
            assert r.n_failed == sum(b & bit != 0 for b in bits)
            assert r.n_only == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)

"""Language ID keeps every string of its training sample: costs against a plain version, and small languages beside large ones."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import language


def plain_cost(trained, text):
    """Bits of a text by prediction by partial matching with escape method C, straight from counts."""
    data = [b"   " + t.encode().lower() for t in trained]
    after = defaultdict(Counter)
    for d in data:
        for i in range(3, len(d)):
            for k in range(4):
                after[d[i - k : i]][d[i]] += 1
    d, bits = b"   " + text.encode().lower(), 0.0
    for i in range(3, len(d)):
        for k in (3, 2, 1, 0):
            seen = after.get(d[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if d[i] in seen:
                bits -= math.log2(seen[d[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_costs_and_a_small_language(spark):
    random.seed(6)
    noise = ["".join(random.choice("0123456789abcdef") for _ in range(40_000)) for _ in range(60)]  # a large label with many strings
    small = {"xx": ["квіт пливе над лугом", "над лугом квіт"], "zz": ["日本語の文書です", "短い文書です"]}
    rows = [("aa", t) for t in noise] + [(k, t) for k, v in small.items() for t in v]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = language.train(docs)
    assert model["langs"] == ["aa", "xx", "zz"]
    assert len(model["tables"][1][0]) >= 4096  # all contexts, not the heaviest
    s = language.Scorer(model)
    for text in ("квіт над", "短い日本語", "00ff квіт", "zq€", noise[0][:300]):
        expected = [plain_cost([t for k, t in rows if k == name], text) for name in ("xx", "zz")]
        assert list(s.code_lengths(text)[1:] / language.SCALE) == pytest.approx(expected, abs=0.01 + 0.002 * len(text))
    assert [s.judge(t)[0] for t in ("квіт над лугом", "日本語の文書", noise[1][:500])] == ["xx", "zz", "aa"]


def test_no_string_of_a_late_language_is_cut(spark):
    """1.3 million different strings of frequent languages do not displace those of a language with one row."""
    random.seed(7)
    letters = [chr(c) for c in range(0x4E00, 0x9FA0)]
    rows = [(f"a{k % 4}", "".join(random.choice(letters) for _ in range(30_000)) * 2) for k in range(16)] + [("zz", "один рядок")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = language.train(docs)
    assert model["langs"] == ["a0", "a1", "a2", "a3", "zz"]
    assert len(model["tables"][2][2]) == sum(len({int(x) for t in {t for k, t in rows if k == name} for x in language._codes(t)}) for name in model["langs"])
    assert language.Scorer(model).judge("один рядок")[0] == "zz"

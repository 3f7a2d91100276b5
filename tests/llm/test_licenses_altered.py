"""Altered copies of license notices are found at every offset; scans against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import licenses


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_altered_copies_at_every_offset(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.CONTAINMENT)
    words = licenses.WORDS.findall(licenses.TEMPLATES[name].lower())
    n = len(words) - licenses.WIDTH + 1
    if n < 10:  # an insertion breaks two shingles, more than a fifth of these
        copies = [words]
    else:
        copies = [words[:8] + [f"x{k}" for k in range(more)] + words[8:] for more in (1, 5, n // 2)]
    own = set(licenses.shingle_hashes(" ".join(words)).tolist())
    for copy in copies:
        kept = len(own & set(licenses.shingle_hashes(" ".join(copy)).tolist())) / len(own)
        for offset in [*range(129), 500, 777, 1023]:
            text = " ".join([*(f"f{k}" for k in range(offset)), *copy, *(f"g{k}" for k in range(130))])
            found = {t: (c, at) for t, c, at in scanner.scan(text)}
            assert name in found, (offset, len(copy))
            assert found[name] == (pytest.approx(kept), offset)


def test_scan_equals_brute_force():
    random.seed(8)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.CONTAINMENT)
    pieces = [licenses.WORDS.findall(t.lower()) for t in licenses.TEMPLATES.values()]
    for _ in range(60):
        words = []
        for _ in range(12):
            piece = list(random.choice(pieces))
            del piece[random.randrange(len(piece)) :][: random.randrange(3)]
            words += piece + [f"w{random.randrange(99)}" for _ in range(random.randrange(20))]
        h, expected = licenses.shingle_hashes(" ".join(words)), []
        for k, s in enumerate(scanner.sets):
            held = [len(np.intersect1d(h[p : p + scanner.windows[k]], s)) if h[p] in s else 0 for p in range(len(h))]  # all windows
            best = int(np.argmax(held))
            if held[best] / len(s) >= licenses.CONTAINMENT:
                expected.append((scanner.names[k], held[best] / len(s), best))
        assert scanner.scan(" ".join(words)) == expected


def test_bands_miss_no_worst_case_window():
    """Copies at the least containment, in windows full of shingles of other templates: the worst similarity the bands are set for."""
    rng = random.Random(5)
    words = {k: [f"{k}w{rng.randrange(10**6)}" for _ in range(60)] for k in range(12)}
    scanner = licenses.Scanner({str(k): " ".join(w) for k, w in words.items()}, licenses.CONTAINMENT)
    for trial in range(300):
        copy = list(words[trial % 12])
        for place in rng.sample(range(3, 57, 9), 3):  # each breaks three of 58 shingles
            copy[place] = f"x{rng.random()}".replace(".", "")
        around = [w for k in rng.sample([k for k in words if k != trial % 12], 6) for w in words[k]]
        at = rng.randrange(len(around))
        found = {t: c for t, c, _ in scanner.scan(" ".join(around[:at] + copy + around[at:]))}
        assert found[str(trial % 12)] >= licenses.CONTAINMENT


def test_edges(spark):
    text = licenses.TEMPLATES["mit"]
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "w " * 200_000 + text), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'t' as template", "1 as start_word", "0.5 as containment")
    found = sorted((str(r.doc_id), r.template, r.start_word) for r in licenses.scan_licenses(docs).collect())
    assert found == [("1", "mit", 0), ("1", "mit", 0), ("4", "mit", 200_000), ("None", "mit", 0)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0

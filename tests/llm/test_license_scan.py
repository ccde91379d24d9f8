"""Labels, scores and tags of licence scans, word by word."""

import itertools
import re
import time

import numpy as np
import pytest
from quire.llm import license_scan


@pytest.mark.parametrize(
    ("line", "rank", "labels"),
    [
        ("MIT", 1, "mit"), ("MIT, see LICENSE", 1, "mit"), ("MIT see LICENSE", 1, "mit"), ('"Apache-2.0"', 1, "apache"), ("`MIT`;", 1, "mit"), ("(MIT OR GPL-2.0) AND BSD-3-Clause */", 1, "bsd,gpl,mit"),
        ("GPL-2.0 WITH Classpath-exception-2.0", 2, "gpl"), ("MIT OR", 1, "mit"), ("MIT AND (GPL-3.0", 1, "mit"), ("(MIT", None, ""), (", MIT", None, ""), ("", None, ""), (")", None, ""),
    ],
)
def test_tags(line, rank, labels):
    n_words, _, _, _, _, found, score, own, forms = license_scan.scan_text(f"x SPDX-License-Identifier: {line}\nnext line MIT")
    assert (found, own) == (labels, rank) and len(forms) == (rank is not None) and (score == 1.0) == (rank is not None)


def test_leading_is_the_longest_prefix():
    rng = np.random.default_rng(3)
    parts = ["MIT", "GPL-2.0", "and", "or", "with", "(", ")", ","]
    for _ in range(3000):
        tokens = rng.choice(parts, rng.integers(0, 9)).tolist()
        want = next((f for n in range(len(tokens), 0, -1) if (f := license_scan.postfix(" ".join(tokens[:n])))), None)
        assert license_scan.leading(" ".join(tokens)) == want, tokens


def test_labels_and_scores():
    rng = np.random.default_rng(4)
    phrases = {**{p: (label, 0.7) for p, label in license_scan.BASE.items()}, **license_scan.NOTICES}
    pieces = [*phrases, "license", "gnu", "the", "Public", "MIT-License", "cc by"]
    for _ in range(400):
        text = ", ".join(rng.choice(pieces, rng.integers(0, 6)))
        words = re.findall(r"[a-z0-9]+", text.lower())
        held = {p for p in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        _, n_base, first, last, base, labels, score, _, _ = license_scan.scan_text(text)
        places = [k for p in license_scan.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert labels == ",".join(sorted({phrases[p][0] for p in held} | {license_scan.BASE[p] for p in held & set(license_scan.BASE)}))
        assert base == ",".join(sorted({license_scan.BASE[p] for p in held & set(license_scan.BASE)}))
        assert score == max([phrases[p][1] for p in held] + [0.7 for p in held if p in license_scan.BASE], default=0)
        assert (n_base, first, last) == (len(places), min(places, default=None), max(places, default=None))


def test_long_lines():
    times = []
    for n in (100_000, 400_000):
        began = time.process_time()
        assert license_scan.scan_text("SPDX-License-Identifier: " + "MIT or " * n)[5] == "mit"
        assert license_scan.scan_text("SPDX-License-Identifier: " + "(" * n)[7] is None
        times.append(time.process_time() - began)
    assert times[1] < 8 * max(0.2, times[0])
    assert list(itertools.islice(license_scan.scan_text("mit license " * 10_000)[1:4], 3)) == [10_000, 0, 19_998]

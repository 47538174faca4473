import hashlib
import itertools
import math
import random
import re
import statistics

import numpy as np

from tessera.llm import secretscan as S

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    out = []
    for kind, pattern, ok in ((0, ASSIGN, lambda m: len(m[2]) >= 12), (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return sorted(out)


def samples():
    rng = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\t", "x.y-z", "K", "ſecret", "_", "/", "Zz9+"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]


def test_base_spans_by_definition():
    for t in samples():
        assert S.base_spans(t) == brute(t), t


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(9)
    b64 = S._ORDER["base64"]
    plant = {k: "see " + "".join(rng.choices(b64, k=40)) + "7aB end" for k in range(150)}
    plain = {1000 + k: "path " + "Version1" * 6 + f" item{k:020d} and plain words" for k in range(300)}
    texts = plant | plain | {5000: None, 5001: "", 5002: "a" * 200_000}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in S.scan(docs).collect()}
    assert set(got) == set(texts)
    found = {d for d, spans in got.items() if any(s.kind == "random" for s in spans)}
    assert len(found & plant.keys()) >= 130 and not found & plain.keys() and not found & {5000, 5001}


def test_query_digests(spark, tmp_path):
    texts = dict(enumerate([*samples()[:200], None]))
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in S.op4_secrets(spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in want).encode()).hexdigest()


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_p(token, kind):
    """The battery, step by step: chi-squared (Wilson-Hilferty), runs about the middle of the alphabet, lag-1 correlation, Fisher."""
    x = [S._PLACE[kind][c] for c in (token.lower() if kind in ("hex", "base36") else token)]
    n, k = len(x), len(S._ORDER[kind])
    tail = lambda z: 1 - statistics.NormalDist().cdf(z)
    chi = sum((x.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    v = 2 / (9 * (k - 1))
    p1 = tail(((chi / (k - 1)) ** (1 / 3) - 1 + v) / v**0.5)
    up = [s >= k / 2 for s in x]
    a, b = up.count(True), up.count(False)
    runs = len([*itertools.groupby(up)])
    p2 = 2 * tail(abs(runs - 1 - 2 * a * b / n) / (2 * a * b * (2 * a * b - n) / (n**2 * (n - 1))) ** 0.5) if a and b else 2 * 0.5**n
    mean = sum(x) / n
    r = sum((s - mean) * (t - mean) for s, t in zip(x, x[1:])) / sum((s - mean) ** 2 for s in x)
    p3 = 2 * tail(abs(r) * n**0.5)
    h = -sum(map(math.log, (p1, p2, p3)))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_battery_matches_its_definition_and_is_level_on_random_tokens():
    rng = random.Random(12)
    for kind, symbols in S._ORDER.items():
        ps = []
        for _ in range(400):
            token = "".join(rng.choices(symbols, k=rng.choice((20, 31, 64))))
            ps.append(S.randomness(token, kind))
            assert abs(ps[-1] - plain_p(token, kind)) < 1e-6
        assert sum(p < 0.05 for p in ps) < 0.13 * len(ps) and sum(p > 0.5 for p in ps) > 0.4 * len(ps)
        assert S.randomness((symbols[:7] * 9)[:40], kind) < 0.01


def test_encodings():
    want = {"0123456789abcdef0123": "hex", "0123456789ABCDEF0123": "hex", "ABCDEFGH234567ABCDEF": "base32", "k3x9z0q8w7e6r5t4y2u1": "base36", "K3X9Z0Q8W7E6R5T4Y2U1": "base36", "abcdefghijklmnopqrst": None, "ABCDEFGHIJKLMNOPQRST": None, "12345678901234567890": None, "AbCdEfGhIjKlMnOpQrSt": "base64", "Ab3/+-_xxxxxxxxxxxxxx": "base64", "a_b-c/1xxxxxxxxxxxxxx": None, "1" * 20: None}
    assert {t: S.encoding(t) for t in want} == want


def test_cuts_match_a_plain_count():
    rng = random.Random(13)
    for _ in range(60):
        ps = [rng.random() for _ in range(rng.randint(0, 300))] + [rng.random() ** 6 for _ in range(rng.randint(0, 900))]
        bins = np.bincount([min(int(p * S.BINS), S.BINS - 1) for p in ps], minlength=S.BINS) if ps else np.zeros(S.BINS)
        want = 2.0
        for k in range(S.BINS // 2 + 1):  # the least cut with few enough ordinary tokens above it
            above, half = bins[k:].sum(), bins[S.BINS // 2 :].sum()
            if above and max(above - 2 * half * (1 - k / S.BINS), 0) <= S.FDR * above:
                want = k / S.BINS
                break
        assert S.thresholds({("hex", 0): bins})["hex", 0] == want


def test_many_secrets_in_one_text():
    text = " ".join(f"token={k:012d}abc deadbeef{k:016x}z {k}x" for k in range(20_000))
    spans = S.base_spans(text)
    assert len(spans) >= 40_000
    got = [*S.candidates(text, spans)]
    assert not any(s < b and a < e for _, a, b, _ in got[:50] for s, _, e in spans)

import hashlib
import random
import re
import string
from pydoc_data.topics import topics

import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import secret_scan
from tests.llm.helpers import docs_frame, odd_documents


def brute(text):
    """Spans of the known formats straight from their definitions."""
    a = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_known_formats_equal_the_definitions(spark):
    rng = random.Random(4)
    parts = ["password", "PassWD", "secret", "api_key", "APIKEY", "token", " ", "=", ":", '"', "'", "AKIA", "ab12" * 6, "f" * 30, "Z9" * 9,
             "é", "\n", "xyz", ".", "/", "ſecret", "toKen", "abc", "-" * 3, "AKIAAKIA"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        spans, r = brute(t), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)], t
        known = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(known.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("random")) == known


def test_random_strings_are_found_and_structured_ones_are_not(spark):
    rng = random.Random(8)
    alpha = string.ascii_letters + string.digits
    rows, keys = [], {}
    for i in range(60):
        key = "".join(rng.choice(alpha) for _ in range(rng.choice([32, 40, 64])))
        keys[i] = key
        rows.append((i, f"see {key} there"))
    plain = ["a1" * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "2020-01-02-2020-01-02-2020-01-02-2020-01-03a",
             "abcdefghijklmnopqrstuvwxyz0123456789" * 2, "data/data/data/data/data/data/data/data/data1"]
    rows += [(100 + k, f"see {plain[k % 5]} there") for k in range(60)]
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs_frame(spark, rows)).collect()}
    hit = sum(("random:4:" + str(4 + len(keys[i]))) in got[i] for i in keys if not brute(rows[i][1]))
    assert hit >= 0.9 * sum(not brute(rows[i][1]) for i in keys)
    assert sum("random" in got[100 + k] for k in range(60)) == 0


PROSE = [t[at:at + 4000] for _, t in sorted(topics.items()) for at in range(0, len(t), 4000)]   # English text


def test_ordinary_model_by_hand():
    text = "ab/ab é\nQ"
    counts = secret_scan.pair_counts(text.encode()).reshape(secret_scan.STATES, -1)
    at = lambda c: secret_scan.SYMBOLS.find(c) if c in secret_scan.SYMBOLS else secret_scan.STATES - 1
    assert counts[at("a"), at("b")] == 2 and counts[at("b"), at("/")] == 1 and counts[at("/"), at("a")] == 1
    assert counts[at("b"), at(" ")] == 1 and counts[at(" "), at("Q")] == 1 and counts.sum() == len(text.encode()) - 1
    model = secret_scan.ordinary_model(counts)
    assert np.allclose(np.exp(model).sum(axis=1), 1)
    long = ("xyz /" * 900_000).encode()   # more than a chunk
    assert secret_scan.pair_counts(long).sum() == len(long) - 1


def test_e_values_of_ordinary_draws_average_at_most_one():
    rng = np.random.default_rng(3)
    model = secret_scan.ordinary_model(secret_scan.pair_counts("\n".join(PROSE).encode()))
    letters, p = [secret_scan.SYMBOLS.index(c) for c in string.ascii_lowercase], np.exp(model)
    small = 0
    for _ in range(400):   # lower-case strings drawn from the model
        x = [secret_scan.STATES - 1]
        while len(x) < 25:
            w = p[x[-1], letters]
            x.append(letters[rng.choice(26, p=w / w.sum())])
        small += secret_scan.oddness("".join(secret_scan.SYMBOLS[c] for c in x[1:]), "lower", model) >= secret_scan.grid_p(0.05)
    assert small <= 0.05 * 400
    keys = ["".join(rng.choice(list(string.ascii_letters), 24)) for _ in range(50)]
    assert min(secret_scan.oddness(k, "letters", model) for k in keys) > secret_scan.grid_p(1e-6)


def test_letters_alone_and_what_known_spans_leave_of_a_run_are_tested(spark):
    rng = random.Random(5)
    draw = lambda alpha, n: "".join(rng.choice(alpha) for _ in range(n))
    rows, at = [], {}
    for i in range(200):
        digest, key = draw("0123456789abcdef", 40), draw(string.ascii_letters, 32)
        if i % 2:
            rows.append((i, f"see {key} there"))
            at[i] = (4, 36)
        else:   # an upper-case letter first, so that the digest ends at the slash
            rows.append((i, f"see {digest}/Z{key} there"))
            at[i] = (45, 78)
    prose = ["internationalization", "getElementsByTagNameAndClassNameInDocument", "the/quick/brown/fox/jumps/over/the/lazy/dogs",
             "counterrevolutionaries", "electroencephalographically"]
    rows += [(300 + k, f"see {prose[k % 5]} there") for k in range(200)]
    rows += [(1000 + k, t) for k, t in enumerate(PROSE)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs_frame(spark, rows)).collect()}
    hit = [f"random:{a}:{b}" in got[i].spans.split(",") for i, (a, b) in at.items()]
    assert sum(hit[1::2]) >= 90 and sum(hit[::2]) >= 90
    assert all(got[i].n_hex == 1 for i in range(0, 200, 2)) and sum(got[i].confirmed for i in range(0, 200, 2)) >= 90
    assert sum("random" in got[300 + k].spans for k in range(200)) <= 10


def test_parts_outside_known_spans():
    text = "x" * 25 + "/" + "y" * 30 + "-" + "z" * 19
    assert secret_scan.uncovered(text, [(0, 76)], []) == [(0, 76)]
    assert secret_scan.uncovered(text, [(0, 76)], [(26, 2, 56)]) == [(0, 25)]
    assert secret_scan.uncovered(text, [(0, 76)], [(0, 0, 25), (10, 2, 20)]) == [(26, 76)]
    assert secret_scan.uncovered(text, [(0, 25), (26, 56)], [(0, 0, 60)]) == []


def test_benjamini_hochberg_by_band(spark):
    rng = random.Random(2)
    ps = [rng.random() ** 4 for _ in range(300)]
    d = spark.createDataFrame([([(0, secret_scan.grid_p(p))],) for p in ps], "runs array<struct<band:int,grid:int>>")
    limit = secret_scan.rejection_limits(d, 0.05)[0]
    rounded = sorted(10 ** (-secret_scan.grid_p(p) / secret_scan.GRID) for p in ps)
    k = max(i + 1 for i, p in enumerate(rounded) if p <= 0.05 * (i + 1) / len(ps))
    assert sum(secret_scan.grid_p(p) >= limit for p in ps) == k
    assert secret_scan.rejection_limits(d, 0.05)[3] > secret_scan.LEAST_P


def test_battery_accepts_random_and_rejects_patterned_strings():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    assert sum(secret_scan.randomness(h)[1] > 0.01 for h in hexes) >= 190
    name, p = secret_scan.randomness("0123456789abcdef" * 4)
    assert name == "hex" and p < 1e-6
    assert secret_scan.randomness("0" * 40)[1] < 1e-6


def test_odd_rows(spark):
    d = docs_frame(spark, odd_documents()).withColumns({"runs": F.lit(1), "spans": F.lit("x")})
    out = secret_scan.find_secrets(d)
    assert out.count() == len(odd_documents()) and out.where("spans != ''").count() == 0
    assert secret_scan.find_secrets(docs_frame(spark, [])).count() == 0

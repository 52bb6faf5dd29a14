"""The corpus operators against brute force on small tables, with the odd rows each must bear."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cloakwork.llm import kdsearch, langid, mixing, pieces, secretscan, simhash, substrings, suffixtree, tokenfile, vectordedup

DOCS = "doc_id long, text string, lang string, source string, extra int"
rng = random.Random(5)
WORDS = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 7))) for _ in range(60)]


def _texts(n):
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 90))) for _ in range(n)]
    out = base + base[: n // 4] + [t + " more words" for t in base[: n // 4]]
    return [*out, "", "  \n", "a", "日本 語 é\ttoken= abcDEF123456 AKIA" + "A1" * 8, "x" * 3000, None]


@pytest.fixture(scope="module")
def rows():
    texts = _texts(40)
    return [(i, t, rng.choice(["en", "es", None]), rng.choice(["a", "b", None]), i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_similar_groups(spark):
    words = [[f"w{i}_{j}" for j in range(200)] for i in range(8)]
    texts = {10 * i + 1: " ".join(w) for i, w in enumerate(words)}
    texts |= {10 * i + 2: " ".join(w[:100] + ["CHANGED"] + w[101:]) for i, w in enumerate(words)}  # similarity 0.95
    texts |= {10 * i + 3: texts[10 * i + 1].upper() for i in range(8)}
    texts |= {10 * i + 4: " ".join(w[:90] + [f"x{i}_{j}" for j in range(110)]) for i, w in enumerate(words)}  # 0.28
    rows = [*texts.items(), (200, None), (201, ""), (202, " \n"), (None, texts[1]), (203, "one"), (204, "one")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keys string")
    got = dict(simhash.similar_groups(docs, spark).collect())
    for i in range(8):
        assert [got[10 * i + k] for k in (1, 2, 3, 4)] == [10 * i + 1, 10 * i + 1, 10 * i + 1, 10 * i + 4]
    assert (got[201], got[202], got[200], got[204], got[None]) == (200, 200, 200, 203, 1)
    assert simhash.similar_groups(docs.limit(0), spark).count() == 0


def test_similar_groups_verify_sets(spark):
    """Short texts at exactly 0.8, sets that differ by repeats alone, and texts just below 0.8."""
    short = {10 * i + k: " ".join(f"s{i}_{j}" for j in range(8 + k)) for i in range(1, 31) for k in (0, 1)}  # 4 of 5 shingles
    base, line = [f"b{j}" for j in range(104)], [f"r{j}" for j in range(10)]
    repeats = {1000: " ".join(base + line * 2), 1001: " ".join(base + line * 20)}  # equal sets
    below = {2000 + 10 * i + k: " ".join(f"t{i}_{j}" for j in range(7 + k)) for i in range(30) for k in (0, 1)}  # 3 of 4
    texts = short | repeats | below
    got = dict(simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark).collect())
    missed = [i for i in range(1, 31) if got[10 * i + 1] != 10 * i]
    assert len(missed) <= 2  # the bands meet 0.995 of such pairs
    assert got[1001] == 1000 and all(got[i] == i for i in below)


def test_near_dup_stage_null_ids(spark):
    words = [f"w{j}" for j in range(60)]
    one, near, other, far = " ".join(words), " ".join([*words, "more"]), " ".join(f"x{j}" for j in range(60)), "all alone"
    rows = [(None, one), (5, one), (3, near), (None, near), (None, other), (None, other + " more"), (None, other), (7, far), (7, far)]
    docs = spark.createDataFrame([(i, t, "en", "a", n) for n, (i, t) in enumerate(rows)], DOCS)
    out = simhash.stage(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 3
    assert {(r.doc_id, r.text) for r in got if r.doc_id} == {(3, near), (7, far)}
    assert [r.text in (other, other + " more") for r in got if r.doc_id is None] == [True]


def test_similar_edges_reach_what_pairs_reach():
    r = np.random.default_rng(6)
    base = [r.integers(0, 1 << 63, 40, np.uint64) for _ in range(5)]
    sets = []
    for _ in range(120):
        one = base[r.integers(5)].copy()
        one[r.integers(0, 40, r.integers(0, 9))] += np.uint64(r.integers(1, 3))
        sets.append(np.unique(one))
    want, got = list(range(120)), list(range(120))
    pairs = [(i, j) for i in range(120) for j in range(120) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    for root, found in ((want, pairs), (got, simhash.similar_edges(sets))):
        for a, b in found:
            x, y = root[a], root[b]
            root[:] = [min(x, y) if v in (x, y) else v for v in root]
    assert got == want


def test_similar_edges_search_wide_fingerprints(monkeypatch):
    """The bit planes name what the sets decide on, and name every pair of similarity 0.8: short sets, large ones, one within another."""
    r = np.random.default_rng(9)
    sets = []
    for n in (4, 8, 20, 100, 800) * 30:
        one = r.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(one), np.unique(np.concatenate([one, r.integers(0, 1 << 63, n // 4, np.uint64)]))]  # 0.8 exactly
    fps = np.stack([simhash.wide_fingerprint(x) for x in sets])
    far = [int.from_bytes((a ^ b).tobytes(), "little").bit_count() for a, b in zip(fps[::2], fps[1::2])]
    assert max(far) <= simhash.WIDE_RADIUS and min(far) > 10
    assert sorted(simhash.similar_edges(sets, fps)) == [(i + 1, i) for i in range(0, len(sets), 2)]
    seen = []
    shared = simhash._shared
    monkeypatch.setattr(simhash, "_shared", lambda one, others: seen.append(len(others)) or shared(one, others))
    simhash.similar_edges(sets, fps)
    assert sum(seen) < 0.6 * len(sets)  # hardly a set but the mate is compared


def test_bucket_edges_reach_what_pairs_reach():
    rng = np.random.default_rng(5)
    for n, width, radius in ((20, 1, 4), (200, 1, 4), (20, 4, 48), (300, 4, 48)):
        base = rng.integers(0, 1 << 63, (6, width), np.uint64)
        fps = base[rng.integers(0, 6, n)].copy()
        fps[:, 0] ^= np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, radius - 2), np.uint64), axis=1)
        near = [[int.from_bytes((a ^ b).tobytes(), "little").bit_count() <= radius for b in fps] for a in fps]
        want, got = list(range(n)), list(range(n))
        for root, pairs in ((want, [(i, j) for i in range(n) for j in range(n) if near[i][j]]), (got, simhash.bucket_edges(fps, radius))):
            for a, b in pairs:
                x, y = root[a], root[b]
                root[:] = [min(x, y) if r in (x, y) else r for r in root]
        assert got == want


def test_packed_edges_reach_what_pairs_reach():
    """Short buckets that share bit planes give the groups that each would give alone."""
    r = np.random.default_rng(8)
    sizes = r.integers(2, simhash.SHORT + 1, 400)
    fps = np.concatenate([r.integers(0, 1 << 63, 3, np.uint64)[r.integers(0, 3, n)] ^ np.uint64(1) << r.integers(0, 64, n, np.uint64) for n in sizes])
    ends = np.cumsum(sizes)
    want, got = list(range(len(fps))), list(range(len(fps)))
    pairs = [(i, j) for lo, hi in zip(ends - sizes, ends) for i in range(lo, hi) for j in range(lo, i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    for root, found in ((want, pairs), (got, simhash.packed_edges(fps, sizes, 4))):
        for a, b in found:
            x, y = root[a], root[b]
            lo, hi = next((lo, hi) for lo, hi in zip(ends - sizes, ends) if lo <= a < hi)
            root[lo:hi] = [min(x, y) if v in (x, y) else v for v in root[lo:hi]]
    assert got == want


def test_secret_rules_are_derived():
    for rule in secretscan.RULES:
        assert (rule.query is None) == (rule.kind == "hex")
    assert secretscan.SecretRule("x", r"(?:foo|barbaz)-[0-9]+", minimum=9).probe == r"(?:foo|barbaz)-[0-9]+"
    assert secretscan.SecretRule("x", r"key-[0-9]+", minimum=9).probe == r"key-[0-9]{5,}"
    assert secretscan.trigrams_of(secretscan.trigram_query(r"ab[0-9]+|xyz")) == set()


def test_stages_bear_clashing_names(spark):
    names = "doc_id long, text string, lang string, source string, cand int, _id int, row int, copies int, spans int"
    docs = spark.createDataFrame([(i, f"password=abcdefgh{i} and words {i}", "en", "a", 1, 2, 3, 4, 5) for i in range(4)], names)
    for stage in (simhash.stage, secretscan.stage, mixing.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} <= {(1, 2, 3, 4, 5)}


def test_simhash(spark, docs, rows):
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs, spark).collect()}

    def naive(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: naive(t) for i, t, *_ in rows}
    group = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    assert got == {i: (fps[i], group[i]) for i in fps}
    assert simhash.simhash_groups(docs.limit(0), spark).count() == 0


def test_mixing(spark, docs, rows):
    sized = mixing.sizes(docs)
    out = mixing.draw(sized, mixing.targets(sized), spark).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    source = {r[0]: r[3] for r in rows}
    sums = Counter()
    target = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        sums[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(sums[s] - t) <= 5 for s, t in target.items())
    again = mixing.draw(sized, mixing.targets(sized), spark).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_stage_null_ids(spark):
    """Rows without an id are drawn each for itself, so that the sources meet their targets."""
    rows = [(i if i % 2 else None, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3], i) for i in range(300)]
    rows += [(1, "w w w", "a", 300), (None, None, None, 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want = {r.source: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    out = mixing.stage(spark, docs, "")
    got, times = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
        times[r.extra] += 1
    assert out.columns == docs.columns and max(times.values()) <= 3
    assert all(abs(got[s] - t) <= 5 for s, t in want.items())
    assert mixing.stage(spark, docs.limit(0), "").count() == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    size = r.integers(1, 500, 300)
    p = np.full(300, 0.37)
    q = mixing.flight(p.copy(), size, r)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_secrets(spark):
    texts = ["password: short, then secret = longenough99", "TOKEN='abcd.efgh/ij' apikey:12345678 AKIAAB", "AKIA" + "Z9" * 7 + " " + "0f" * 20, "token: secret: abcdefghi", "", None, "ſecret=abcdefghijk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secretscan.scan(docs, spark).collect()}
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in rule.finditer(t) if len(m[2]) >= 8 and "ſ" not in m[1]]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(got[i]) == sorted(want)


def test_top_k(spark):
    r = np.random.default_rng(2)
    vecs = [(i, r.normal(size=6).round(2).tolist()) for i in range(700)] + [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (703, [1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = kdsearch.top_k(df, df.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding"), spark, 5).collect()
    x = {i: [math.floor(1024 * c) for c in v] for i, v in vecs[:700]}
    want = []
    for q in range(0, 700, 100):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(g) for g in got) == want


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    v = [b.tolist() for b in base] + [(b + r.normal(size=16) * 0.05).tolist() for b in base[:20]] + [base[0].tolist()] * 3 + [[0.0] * 16, None, [float("inf")] * 16]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectordedup.near_vectors(df, spark).collect()}
    ok = [i for i in range(len(v) - 3)]
    m = np.array([v[i] for i in ok])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    assert all(got[i][0] == near[i].sum() - 1 for i in ok)
    assert got[0][1] == 0 and got[80][1] == 0 and got[83] == (0, 83) and got[84] == (0, 84)


def test_vectors_near_the_least_cosine_and_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "PART", 16)
    r = np.random.default_rng(6)
    base = r.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=(300, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = r.uniform(0.9, 0.92, 300)[:, None]
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side, base[0] + r.normal(size=(200, 64)) * 0.01])
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, node string")
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectordedup.near_vectors(df, spark).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    n = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert len(got) == len(v) and all(got[i][0] <= n[i] for i in range(len(v)))
    assert sum(got[i][0] for i in range(len(v))) >= 0.99 * n.sum()
    assert sum(got[300 + i] == (1, i) for i in range(1, 300)) >= 0.9 * 299
    assert {got[i][1] for i in range(600, 800)} == {0}


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfile.default_tokenizer())
    got = sorted(tuple(r) for r in tokenfile.read_documents(tokenfile.write_shards(docs, spark), spark).collect())
    start, want = 0, []
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 300, 3000).astype("<u4")
    _, _, m = tokenfile.unpack(tokenfile.pack([1], np.array([3000]), ids))
    assert (m.sequence() == ids).all() and all(m.access(i) == ids[i] for i in range(0, 3000, 97))
    places = np.flatnonzero(ids == ids[7])
    assert m.count(int(ids[7])) == len(places) and [m.occurrence(int(ids[7]), k) for k in range(len(places))] == places.tolist()


def _removed(rows):
    """By brute force: of each (id, text) in the order of documents, each once, what stays of it."""
    seen, out = set(), {}
    for i, t in rows:
        if (i, t) in out:
            continue
        b = (t or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cut[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for k in range(len(b)) if cut[k] and (not k or not cut[k - 1]))
        out[i, t] = (len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT_CONTEXTS, 1])
def test_substrings(spark, docs, rows, hot):
    want = _removed((i, t) for i, t, *_ in rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, spark, hot_contexts=hot).collect()}
    assert got == {i: v for (i, _), v in want.items()}


def test_substrings_of_repeated_rows(spark, rows):
    """Equal rows are one document; a null id comes first; texts under one id are searched in the order of their hashes."""
    some = [(i, t) for i, t, *_ in rows if i % 3 == 0] + [(None, rows[3][1]), (500, "".join(f"{k} " for k in range(300)))]
    want = _removed(sorted(some, key=lambda r: (r[0] is not None, r[0])))
    got = substrings.remove_repeats(spark.createDataFrame(some + some, "doc_id long, text string"), spark).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(2 * [str((i, *v)) for (i, _), v in want.items()])
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string, doc int"), spark).count() == 0


def test_suffix_sort():
    data = np.frombuffer(b"abcabcabd" * 40, np.uint8)
    starts = np.arange(len(data) - substrings.WIDTH + 1)
    h = substrings.PrefixHash(data)
    order, same = substrings.sorted_runs(h, starts, np.zeros(len(starts), np.int64))
    keys = [bytes(data[s : s + substrings.WIDTH]) for s in starts[order]]
    assert keys == sorted(keys) and [False, *[a == b for a, b in zip(keys, keys[1:])]] == same.tolist()


def test_language_model(spark, docs, rows):
    got = {r.doc_id: r for r in suffixtree.score_texts(docs, ~langid.held_out("doc_id", 7, 2), spark).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t, *_ in rows}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert got[i].train_tokens == n and got[i].n_tokens == len(ws) and got[i].n_known == sum(c[w] > 0 for w in ws)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and got[i].score < 0


def test_suffix_tree_keeps_all_contexts(spark):
    """More contexts diverge than any fixed number that the tree once held; all must be in it."""
    r = np.random.default_rng(3)
    suffixes = r.choice(np.arange(64 * 64, 64**3), 600, replace=False)
    contexts = (np.arange(1, 64)[:, None] * 64**3 + suffixes).ravel()
    grams = {int(c) * 64 + int(x): 100 for c, x in zip(contexts, r.integers(1, 64, len(contexts)))}
    got = {g.gram: (g.logp, g.state) for g in suffixtree.grow(spark.createDataFrame(list(grams.items()), "gram long, n long"), spark, 4).collect()}
    assert len(got) == len(contexts) and all(state == 4 for _, state in got.values())
    count, total, kinds = Counter(), Counter(), {}
    for g, n in grams.items():
        for d in range(5):
            count[d, g % 64 ** (d + 1)] += n
            total[d, g % 64 ** (d + 1) // 64] += n
            kinds.setdefault((d, g % 64 ** (d + 1) // 64), set()).add(g % 64)
    gain = Counter()
    for (d, g), n in count.items():
        up = d - 1, g % 64**d
        gain[d, g // 64] += n * math.log(n / total[d, g // 64] / (count[up] / total[d - 1, up[1] // 64])) if d else 0
    for g in list(grams)[::500]:
        p = (count[0, g % 64] + 1) / (total[0, 0] + 64)
        for d in range(1, 5):
            c = d, g % 64 ** (d + 1) // 64
            if gain[c] > suffixtree.GAIN and total[c] >= suffixtree.LEAST_COUNT:
                p = (count[d, g % 64 ** (d + 1)] + len(kinds[c]) * p) / (total[c] + len(kinds[c]))
        assert got[g][0] == pytest.approx(math.log10(p))
    assert suffixtree.depth_for(10**6) == 4 < suffixtree.depth_for(10**9) < suffixtree.depth_for(10**12)


def test_language_id(spark):
    en, es = ["the thing and that is with the other"] * 3, ["el perro de la casa que está aquí"] * 3
    rows = [(i, t, "en" if i < 30 else "es", None, 0) for i, t in enumerate(en * 10 + es * 10)] + [(100, None, "en", None, 0), (101, "12 34", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df.select("lang", "text"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == ("en" if i < 30 else "es") for i in range(60)) and got[100].lang_pred == got[101].lang_pred == "und"
    assert langid.predict(df, langid.train(df.limit(0).select("lang", "text"))).first().lang_pred == "und"
    assert sorted(r.doc_id for r in langid.keep_identified(df, model).collect()) == list(range(60))


def test_keep_identified_rejects(spark):
    """What fits no learned language goes; what is written in one stays."""
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(clean.select("lang", "text"))
    assert langid.keep_identified(clean, model).count() == clean.count()
    junk = ["xkcdqzvw qqzzxx wvvkq jjxqz " * 5, "asdf qwer zxcv uiop hjkl " * 8, "日本語の文章はこのように書かれています", "Это русский текст о погоде и городе", "Wikipedia on yhteisöllisesti toimitettu monikielinen tietosanakirja"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, model).count() == 0
    some = {r.lang: r.text for r in clean.where("length(text) between 500 and 1500").orderBy("doc_id").collect()}
    mixed = [(i, some[a] + " " + some[b], None) for i, (a, b) in enumerate([("en", "de"), ("fr", "es"), ("de", "fr"), ("en", "es")])]
    assert langid.keep_identified(spark.createDataFrame(mixed, docs.schema), model).count() == 4


def test_pieces(spark, docs, rows):
    model = pieces.PieceModel.of(["<b>", *[f"<{b}>" for b in range(256)], "▁", "▁a", "b", "ab", "▁ab", "a", "c", "abc"], [*range(257, 265)], list(range(1, 257)))
    units = ["▁abcab", "▁", "zab", "abcabc", "▁▁a"]
    assert model.viterbi_many(units) == [model.viterbi(u) for u in units]
    out = pieces.encode(docs)
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows) and out.where("not round_trip").count() == 0
    assert pieces.PieceEncoder(pieces.PieceModel.load(pieces.default_pieces())).encode(["", "a▁ b"])[0] == b""


def test_pipeline_runs_all_stages(spark, tmp_path):
    import corpus_pipeline

    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [tuple(r) for r in some] + [(None, *tuple(some[0])[1:]), tuple(some[1]), (None, "12 34", "en", "src0", 5), (900, None, "en", "src0", 0)]
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert out and ids <= {r.doc_id for r in some} and max(Counter(r.doc_id for r in out).values()) <= 3


def test_workers_drop_what_other_operators_kept(spark):
    """A language stage finds nothing of the pieces' memory in a worker, and gets small batches of texts."""
    from cloakwork.llm import common

    mine = common.memory("pieces")
    mine["x"] = 1
    assert common.memory("pieces") is mine and mine == {"x": 1}
    assert common.memory("langid") == {} and mine == {} and "pieces" not in common._MEMORY
    docs = spark.createDataFrame([(i, "the cat and dog" if i % 2 else "el gato y perro", "en" if i % 2 else "es") for i in range(3000)], "doc_id long, text string, lang string").coalesce(1)
    langid.train(docs)
    most = docs.select("text").mapInArrow(lambda batches: (b.select([]).from_arrays([[b.num_rows]], ["n"]) for b in batches), "n long").agg({"n": "max"}).first()[0]
    assert most <= common.TEXT_ROWS


def test_symbols_are_counted_in_small_steps(monkeypatch):
    """Texts of 3 MB are laid out a step at a time, and the counts are those of all at once."""
    import pyarrow as pa

    texts = [f"{i} " + "some words here. " * 2000 for i in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 5 == 0 for i in range(90)]), pa.array(texts), pa.array([7] * 90, pa.int64())], ["held_out", "text", "chunk"])
    stream, most = suffixtree._stream, []
    monkeypatch.setattr(suffixtree, "_stream", lambda chosen, depth: most.append(sum(len(w) for t in chosen for w in t)) or stream(chosen, depth))

    def counts():
        return sorted(r for b in suffixtree._count(iter([batch]), 4) for r in zip(*(c.to_pylist() for c in b.columns)) if r[1] is not None)

    small = counts()
    assert len(most) > 2 and max(most) <= suffixtree.STEP == 1 << 20
    monkeypatch.setattr(suffixtree, "STEP", 1 << 24)
    assert small == counts()


def test_count_holds_distinct_grams_alone(monkeypatch):
    """Counting a chunk takes memory by its distinct symbol runs, not by its text, and hands them on in batches of ROWS."""
    import tracemalloc

    import pyarrow as pa

    from cloakwork.llm import common

    monkeypatch.setattr(suffixtree, "STEP", 1 << 18)
    r = np.random.default_rng(7)
    texts = [bytes(r.integers(97, 123, 1 << 18).astype(np.uint8)).decode() for _ in range(2)]

    def counted(n):
        batch = pa.RecordBatch.from_arrays([pa.array([False, True] * n), pa.array(texts * n), pa.array([4] * (2 * n))], ["held_out", "text", "chunk"])
        tracemalloc.start()
        grams, most = Counter(), 0
        for b in suffixtree._count(iter([batch]), 5):
            most = max(most, b.num_rows)
            grams.update(dict(zip(*(c.drop_null().to_pylist() for c in (b.column(1), b.column(3))))) if b.column(0).null_count else {})
            assert set(b.column(2).to_pylist()) == {4}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return grams, most, peak

    (once, most, low), (often, _, high) = counted(1), counted(15)
    assert most <= common.ROWS and len(once) > 100_000
    assert often == Counter({g: 15 * n for g, n in once.items()}) and set(once.values()) >= {0, 1}
    assert high < 1.5 * low, (low, high)

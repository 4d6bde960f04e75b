"""Each operator against a brute-force version, on rows made to be awkward."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import components, exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity
from tidewatch.llm.shingles import WordHashes, shingle_set


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1


@pytest.mark.parametrize("budget", [64 << 20, 40_000])
def test_exact_groups(corpus, budget):
    groups = defaultdict(list)
    for i, t in rows_of(corpus):
        groups[lower(t)].append(i)
    got = exact_dedup.exact_groups(corpus, budget).collect()
    wanted = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        wanted.update((i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == wanted
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_drop_keeps_one_row_each(clashing, none):
    out = exact_dedup.drop_exact_copies(clashing)
    assert out.columns == clashing.columns
    assert Counter(lower(t) for _, t in rows_of(out)) == Counter({lower(t) for _, t in rows_of(clashing)})
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_open_table_compares_contents():
    table = exact_dedup.OpenTable()
    for i in range(3000):
        entry, at = table.find(7, b"%d" % i)  # one hash for all
        assert entry == -1
        table.insert(7, b"%d" % i, at) if i < 50 else None
        if i >= 50:
            break
    assert [table.find(7, b"%d" % i)[0] for i in range(50)] == list(range(50))


# 2


def test_licenses(corpus):
    got = Counter()
    for r in licenses.scan_licenses(corpus).collect():
        got[(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])] += 1
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    wanted = Counter()
    for i, t in rows_of(corpus):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        wanted[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert got == wanted


def test_license_templates(spark):
    notes = {label: wording.replace(" ", ", ").upper() for label, _, wording in licenses.TEMPLATES}
    shuffled = "license version 2 0 apache under the licensed"
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*notes.values(), shuffled, "mit licenses", "xcc byx"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.scan_licenses(df).collect()}
    for k, label in enumerate(notes):
        assert label in got[k][0] and got[k][1] == 1.0
    assert got[len(notes)] == ([""], 0.0) and got[len(notes) + 1] == ([""], 0.0) and got[len(notes) + 2] == ([""], 0.0)


def test_license_edges(none, clashing):
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(clashing).count() == clashing.count()


# 3


def brute_counts(t):
    w = words(t)
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    repeated = {k for at in where.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(corpus, labels):
    got = Counter(tuple(r)[:7] for r in quality.judge_quality(corpus, labels).collect())
    wanted = Counter()
    for i, t in rows_of(corpus):
        c = brute_counts(t)
        wanted[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == wanted
    assert all(not r["kept"] for r in quality.judge_quality(corpus, labels).where("base_failed").collect())


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.02), (400, 9, 0.01)):
        assert math.isclose(quality.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def _rejected(levels, steps):
    """First level that rejects each text, or the number of levels."""
    hit = (steps[:, None, :] >= levels[None]).any(axis=2)
    return np.where(hit.any(axis=1), hit.argmax(axis=1), len(levels))


def test_cutoffs_control_joint_false_rejection():
    """Seven rules act at once; what all of them reject of the good texts stays under the limit."""
    rng, rules, limit, alpha = np.random.default_rng(0), 7, 0.01, 0.05
    count = lambda steps: np.stack([np.bincount(steps[:, r], minlength=quality.STEPS + 1) for r in range(rules)]).astype(float)
    good = lambda n: np.minimum(rng.poisson(8, (n, rules)), quality.STEPS)
    broken, used, acting = 0, 0, []
    for _ in range(200):
        junk = good(600)
        junk[np.arange(600), rng.integers(0, rules, 600)] += rng.poisson(9, 600)  # each is junk by one rule
        junk = np.minimum(junk, quality.STEPS)
        tune, held = good(2500), good(2500)
        levels = quality.lay_levels(count(tune), count(junk))
        assert (np.diff(levels, axis=0) <= 0).all()
        by = lambda steps: np.bincount(_rejected(levels, steps), minlength=len(levels) + 1)
        level = quality.certified_level(by(held), by(tune), by(junk), alpha, limit)
        if level is not None:
            used += 1
            acting.append(int((levels[level] <= quality.STEPS).sum()))
            broken += float((good(20_000) >= levels[level]).any(axis=1).mean()) > limit
    assert used > 100 and max(acting) >= 5
    assert broken <= 200 * alpha + 3 * (200 * alpha * (1 - alpha)) ** 0.5
    none = np.zeros((rules, quality.STEPS + 1))
    assert (quality.lay_levels(none, none) == quality.STEPS + 1).all()
    assert quality.certified_level(*[np.zeros(len(quality.LOSSES) + 1)] * 3, 0.05, 0.02) is None


def test_copies_are_one_trial(spark):
    """A thousand copies of one good text certify nothing."""
    good = " ".join(f"word{k}" for k in range(60))
    junk = [" ".join(f"#%{k * 7919 % 997}${i}&" for k in range(80)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([good] * 1000 + junk)], "doc_id long, text string, lang string")
    marks = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    assert quality.judge_quality(docs, marks).where("kept").count() == 1300


def test_quality_learns_cutoffs(spark):
    clean, junk = "plain words in rather ordinary sentences here " * 10, "%%% word ### other $$$ " * 30
    clean = [f"{' '.join(f'{clean.split()[(i * 7 + k) % 60]}{(i * 31 + k * 17) % 97}' for k in range(70))}" for i in range(1500)]
    junk = [" ".join(f"#%{k * 7919 % 997}${i}&" for k in range(80)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    marks = docs.select("doc_id", (F.col("doc_id") < 1500).cast("int").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, marks).collect()}
    assert all(got[i] for i in range(1500)) and not any(got[i] for i in range(1500, 1800))
    extra = docs.select("*", *[F.lit(1).alias(n) for n in ("th", "stratum", "cuts", "n_words")])
    assert quality.drop_low_quality(extra, marks).columns == extra.columns
    assert quality.drop_low_quality(extra, marks).count() == 1500


def test_quality_edges(none, labels, clashing):
    assert quality.judge_quality(none, labels).count() == 0
    assert quality.drop_low_quality(clashing, labels.limit(0)).columns == clashing.columns


# 4


def test_packing_round_trip(corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack_documents(corpus, capacity=64).collect()
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows_of(corpus)]
    wanted = Counter((i, k, at, len(own[at : at + 64]), zlib.crc32(np.array(own[at : at + 64], "<u4").tobytes())) for i, own in ids for k, at in enumerate(range(0, len(own), 64)))
    assert Counter(tuple(p)[:5] for p in pieces) == wanted
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * -(-sum(len(own) for _, own in ids) // 64) + 5


def test_sum_of_squares_places_as_defined():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 20, 200)
    bins, offsets = packing.sum_of_squares(sizes, 20)
    fill = Counter()
    for i in np.argsort(-sizes, kind="stable"):
        s, b = int(sizes[i]), int(bins[i])
        fits = {x: f for x, f in fill.items() if f + s <= 20}
        open_at = Counter(f for f in fill.values() if f < 20)
        if fits:
            def squares(f):
                after = Counter(open_at)
                after[f] -= 1
                if f + s < 20:
                    after[f + s] += 1
                return sum(v * v for v in after.values())
            assert squares(fill[b]) == min(squares(f) for f in set(fits.values()))
        else:
            assert b not in fill
        assert offsets[i] == fill[b]
        fill[b] += s
    assert max(fill.values()) <= 20


def test_packing_hardly_depends_on_how_rows_lie(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(vocabulary[k] for k in rng.integers(0, 300, int(rng.integers(20, 900))))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for parts in (1, 8, 48):
        pieces = packing.pack_documents(docs.repartition(parts)).collect()
        by = Counter()
        for p in pieces:
            by[p["sequence_id"]] += p["length"]
        assert max(by.values()) <= packing.SEQUENCE and len({(p["doc_id"], p["piece"]) for p in pieces}) == len(pieces)
        found[parts] = len(by), -(-sum(by.values()) // packing.SEQUENCE)
    assert all(n <= 1.02 * least + 1 for n, least in found.values()), found


def test_packing_edges(none, clashing):
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(clashing).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


# 5


def brute_near(rows):
    hashes = WordHashes()
    sets = [set(shingle_set(t.encode() if t else None, hashes).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("cluster_texts", [4000, 6])
def test_near_groups(corpus, cluster_texts):
    got = near_dedup.near_groups(corpus, cluster_texts).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute_near(rows_of(corpus))


def test_shingles_match_definition():
    hashes = WordHashes()
    a = shingle_set(b"A b c d e f", hashes)
    assert len(a) == 2 and len(np.intersect1d(a, shingle_set(b"a B  c\td e", hashes))) == 1
    assert len(shingle_set(b"a b", hashes)) == 1 and len(shingle_set(b"a b a b a b a b a b", hashes)) == 2
    assert not np.array_equal(shingle_set(b"a b", hashes), shingle_set(b"b a", hashes))


def test_adaptive_prefix_never_loses_a_partner():
    rng = np.random.default_rng(2)
    for _ in range(200):
        base = rng.choice(2**40, 60, replace=False).astype(np.uint64)
        x, y = np.sort(base[: rng.integers(45, 58)]), np.sort(base[rng.integers(0, 6) :])
        n = len(np.intersect1d(x, y))
        if 100 * n < 80 * (len(x) + len(y) - n):
            continue
        df = dict.fromkeys(base.tolist(), 1)
        for t in np.intersect1d(x, y).tolist():
            df[t] = int(rng.integers(2, 50))
        (lx, px), (ly, py) = (near_dedup.adaptive_prefix(s, np.array([df[t] for t in s.tolist()])) for s in (x, y))
        assert lx and ly and len(np.intersect1d(px, py)) >= min(lx, ly)


def test_near_drop(clashing, none):
    out = near_dedup.drop_near_copies(clashing)
    kept = Counter(r[0] for r in rows_of(out))
    groups = defaultdict(list)
    for r in near_dedup.near_groups(clashing).collect():
        groups[r["component_id"] if r["n_shingles"] else ("empty", r["doc_id"])].append(r["doc_id"])
    assert set(kept) == {min((d for d in g if d is not None), default=None) for g in groups.values()}
    assert near_dedup.drop_near_copies(none).count() == 0 and near_dedup.near_groups(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix(corpus):
    got = mixing.mix(corpus).collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(d["words"] for d in r["draws"])
        sizes[r["source"]] += r["size"]
    target, taken = brute_targets(sizes), Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1.5 for s, t in target.items())


def test_mix_is_the_same_however_rows_lie(corpus):
    pick = lambda df: sorted((str(r["doc_id"]), r["text"] or "", r["taken"], str(r["draws"])) for r in mixing.mix(df).collect())
    assert pick(corpus) == pick(corpus.repartition(3)) == pick(corpus.coalesce(1))


def test_mix_shards_are_even(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    draws = mixing.mix(docs, shards=8).select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("n")).collect()
    assert len(draws) == 8 and max(r["n"] for r in draws) < 1.2 * min(r["n"] for r in draws)


def test_targets_fill_and_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 500, "": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert all(math.isclose(got[s], t, rel_tol=1e-12) for s, t in brute_targets(sizes).items())


def test_tree_halves_every_node():
    def leaf(rank, total, levels):
        node, at, n = 0, rank, total
        for _ in range(levels):
            left = (n + 1) // 2
            node, at, n = (2 * node + 1, at - left, n - left) if at >= left else (2 * node, at, left)
        return node

    for total in (1, 7, 64, 1000):
        sizes = Counter(leaf(r, total, 3) for r in range(total))
        assert max(sizes.values()) - min(sizes[k] for k in range(8)) <= 1


def test_random_order_and_tree(spark):
    units = spark.range(3000).select(F.when(F.col("id") < 1000, None).otherwise("s").alias("source"), F.col("id").alias("nth"))
    ordered, n = mixing.in_random_order(units, 7)
    rows = ordered.select("source", "nth", "rank", mixing.tree_node(F.col("rank"), n, 4).alias("node")).collect()
    assert n == 3000 and sorted(r["rank"] for r in rows) == list(range(3000))
    sizes = Counter(r["node"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    share = Counter(r["node"] for r in rows if r["source"] is None)  # hypergeometric: mean 62.5, deviation about 6.4
    assert all(abs(share[k] - 62.5) < 26 for k in range(16))
    assert sorted(r["node"] for r in rows) == [r["node"] for r in sorted(rows, key=lambda r: r["rank"])]


def test_mix_sizes_agree_with_mix(corpus, clashing):
    pick = lambda df: sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["draws"])) for r in df.collect())
    assert pick(mixing.mix_sizes(corpus)) == pick(mixing.mix(corpus)) == pick(mixing.mix(clashing))
    assert mixing.mixed_documents(clashing).columns == clashing.columns


def test_mix_edges(none, clashing):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mix(clashing).count() == clashing.count()


# 7


def test_sharding(clashing, none):
    limit = 2000
    got = sharding.shard_documents(clashing, limit).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in clashing.collect())
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) and a != b for a in names for b in names)
    total = Counter()
    for name, own in shards.items():
        size = sum(r["n_bytes"] for r in own)
        assert all((r["shard_bytes"], r["shard_rows"], r["shard_depth"]) == (size, len(own), len(name)) for r in own)
        assert size <= limit or len({(r["doc_id"], r["text"]) for r in own}) == 1
        for k in range(len(name)):
            total[name[:k]] += size
    assert all(n > limit for n in total.values())  # nothing was split that fitted
    assert sharding.shard_documents(none, limit).count() == 0


def test_sharding_goes_deeper_than_one_step(spark, monkeypatch):
    monkeypatch.setattr(sharding, "size_hint", lambda df: 1)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    out = sharding.shard_documents(docs, 100)
    assert out.agg(F.max("shard_bytes")).first()[0] <= 100 and out.agg(F.max("shard_depth")).first()[0] > sharding.STEP_BITS


# 8


def test_gradients_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    rng = np.random.default_rng(1)
    p = {k: (v.astype(float) if isinstance(v, np.ndarray) else v) for k, v in toxicity.new_parameters({}, np.empty(0, np.uint64)).items()}
    x, mask = rng.standard_normal((5, 4, toxicity.EMBED)), np.ones((5, 4), bool)
    mask[3:, 1] = mask[1:, 3] = False
    loss = lambda: toxicity.gradients(p, x, mask, np.array([0, 0, 1, 2]), np.array([1, 0, 1]), np.ones(3))
    _, g, dx = loss()
    for a, d in [(p[k], g[k]) for k in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "A", "v", "u", "c")] + [(x, dx)]:
        at = tuple(rng.integers(0, s) for s in a.shape)
        a[at] += 1e-6
        up = loss()[0]
        a[at] -= 2e-6
        down = loss()[0]
        a[at] += 1e-6
        assert math.isclose((up - down) / 2e-6, d[at], rel_tol=1e-3, abs_tol=1e-8)


def test_windows_overlap_and_cover():
    for n in (0, 1, 63, 64, 65, 500):
        cuts = toxicity.windows_of(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(b[0] < a[1] for a, b in zip(cuts, cuts[1:], strict=False))


def test_toxicity_on_held_out(spark):
    rng = np.random.default_rng(3)
    vocabulary, bad = [f"w{i}" for i in range(300)], ["vile", "rotten", "foulest"]
    docs = []
    for i in range(900):
        own = [vocabulary[k] for k in rng.integers(0, 300, int(rng.integers(5, 220)))]
        if i % 4 == 0:
            for _ in range(3):
                own[int(rng.integers(0, len(own)))] = bad[int(rng.integers(0, 3))]
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, "w1")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, marks, budget=8000)).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    right = np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held])
    assert right > 0.95


def test_scores_do_not_depend_on_company():
    docs = [[b"w%d" % (k * i % 50) for k in range(30 * i)] for i in range(1, 12)]
    model = toxicity.train(docs, [i % 2 for i in range(11)], budget=30)
    together = toxicity.Scorer(model).logits(docs)
    assert np.allclose(together, [toxicity.Scorer(model).logits([d])[0] for d in docs], atol=1e-4)


def test_scores_match_a_plain_forward_pass():
    """Every window of every text, word by word and step by step, against the batched scorer."""
    rng = np.random.default_rng(6)
    vocabulary = [b"w%d" % k for k in range(60)] + [b"vile!", b"(foul)", b"x" * 70]
    docs = [[vocabulary[k] for k in rng.integers(0, len(vocabulary), int(n))] for n in (0, 1, 5, 64, 65, 150, 300)]
    texts = [b" ".join(d) for d in docs]
    cut = [toxicity.words_of(t) for t in texts]
    p = toxicity.train(cut * 3, [i % 2 for i in range(21)], budget=60)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.asarray(x, float)))
    grams = p["grams"].tolist()

    def embed(word):
        bare = toxicity.bare_word(word)
        own = [grams.index(h) + 1 for h in toxicity.grams_of([bare])[0].tolist() if h in grams]
        chars = sum((p["char"][g].astype(float) for g in own), np.zeros(toxicity.EMBED)) / max(1, len(own))
        return p["word"][p["words"].get(bare, 0)] + chars

    def states(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs if d == "f" else xs[::-1]:
            (az, ar, an), (uz, ur, un) = np.split(x @ p[f"W{d}"] + p[f"b{d}"], 3), np.split(h @ p[f"U{d}"], 3)
            z, r = sigmoid(az + uz), sigmoid(ar + ur)
            h = z * h + (1 - z) * np.tanh(an + r * un)
            out.append(h)
        return out if d == "f" else out[::-1]

    def logit(words):
        if not words:
            return float(p["c"][0])
        xs = [embed(w) for w in words]
        both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs, "b"), strict=True)]
        score = np.array([float(np.tanh(s @ p["A"]) @ p["v"][:, 0]) for s in both])
        weight = np.exp(score - score.max())
        return float(sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True)) @ p["u"][:, 0] + p["c"][0])

    plain = [max(logit(d[a:b]) for a, b in toxicity.windows_of(len(d))) for d in cut]
    wanted = sigmoid(np.clip(plain, -15, 15) * float(p["scale"][0]) + float(p["shift"][0]))
    assert np.allclose(toxicity.Scorer(p)(texts), wanted, atol=1e-4)
    assert np.allclose(toxicity.Scorer(p)([None]), wanted[:1], atol=1e-4)


def test_training_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda documents, labels, budget: seen.append((len(documents), labels)))
    df = spark.createDataFrame([(i, "w " * (10 if i % 2 else 400)) for i in range(40)], "doc_id long, text string")
    marks = df.select("doc_id", F.lit(0).alias("toxic"))
    toxicity.fit_toxicity(df, marks, text_bytes=100)
    toxicity.fit_toxicity(df, marks, per_class=5, text_bytes=10_000)
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert [n for n, _ in seen] == [sum(i % 2 for i in held), 5]


def test_toxicity_edges(none, labels, corpus):
    model = toxicity.fit_toxicity(none, labels, budget=10)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.score_toxicity(corpus, model).count() == corpus.count()


# 9


def brute_runs(rows, least):
    """Lines to delete: those in a run of enough words that also stands earlier."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    lines = [[x.strip() for x in t.split("\n") if words(x)] for _, _, t in docs]
    gone = [set() for _ in docs]
    for b, lb in enumerate(lines):
        for a in range(b + 1):
            la = lines[a]
            for i in range(len(lb)):
                for j in range(len(la)):
                    if (a, j) >= (b, i) or la[j] != lb[i] or (i and j and la[j - 1] == lb[i - 1]):
                        continue
                    k = 0
                    while i + k < len(lb) and j + k < len(la) and la[j + k] == lb[i + k]:
                        k += 1
                    if sum(len(words(x)) for x in lb[i : i + k]) >= least:
                        gone[b] |= set(range(i, i + k))
    return {(d if known else None, t): g for (known, d, t), g in zip(docs, gone, strict=True)}


def test_line_dedup(corpus, spark):
    more = spark.createDataFrame([(5000, "p q\nr s t\nu v\nw\nx y z"), (5001, "a\nr s t\nu v\nw\nb"), (5002, "k k\nk k\nk k\nk k\nk k"), (5003, "p q\nr s t\nend"), (5004, "\n\nu v\n\nw\nx y z\n")], "doc_id long, text string")
    for least, docs in ((5, more), (50, corpus)):
        docs = docs.select("doc_id", "text")
        gone = brute_runs(rows_of(docs), least)
        for r in line_dedup.drop_repeated_lines(docs.withColumn("original", F.col("text")), least).collect():
            own = gone[r["doc_id"], r["original"] or ""]
            kept = [x.strip() for i, x in enumerate(x for x in (r["original"] or "").split("\n") if words(x)) if i not in own]
            assert [x.strip() for x in (r["text"] or "").split("\n") if words(x)] == kept
            assert r["n_removed"] == len(own)


def test_line_dedup_edges(none, clashing):
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert line_dedup.drop_repeated_lines(clashing).count() == clashing.count()


# 10


def test_token_counts(corpus):
    scores = token_counts.zipf_scores(token_counts.vocabulary_path())
    worst = min(scores.values()) - 10.0

    def best(word):
        text = token_counts.WORD_START + word
        table = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(table[end - 1][0] + size * worst, table[end - 1][1] + size)]
            options += [(table[s][0] + scores[text[s:end]], table[s][1] + 1) for s in range(end) if text[s:end] in scores]
            top = max(o[0] for o in options)
            table.append((top, min(n for score, n in options if score == top)))
        return table[-1][1]

    rows = rows_of(corpus)
    known = {w: best(w) for w in {w for _, t in rows for w in words(t)}}
    assert Counter(tuple(r) for r in token_counts.count_tokens(corpus).collect()) == Counter((i, len(words(t)), sum(known[w] for w in words(t))) for i, t in rows)


def test_trie_is_kept_and_bounded(monkeypatch):
    scores = token_counts.zipf_scores(token_counts.vocabulary_path())
    batches = [[b"station stations stationery", b"stall"], [b"stationed station", b"x\xc3\xa9y"], [b"stallion zzzz"]]
    whole = token_counts.TrieCounter(scores)
    wanted = [whole(b) for b in batches]
    nodes = len(whole.best)
    whole([b"stationeries"])
    assert len(whole.best) == nodes + 3  # "ies" alone is new
    for most in (1, 2, 9, 20):
        monkeypatch.setattr(token_counts, "TRIE_NODES", most)
        small = token_counts.TrieCounter(scores)
        assert [small(b) for b in batches] == wanted and len(small.best) <= most


def test_token_count_edges(none, clashing):
    assert token_counts.count_tokens(none).count() == 0
    assert token_counts.count_tokens(clashing).count() == clashing.count()


def test_license_case(spark):
    df = spark.createDataFrame([(1, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3"), (2, "K MİT LICENSE"), (3, "mité license")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: (12, 1, "gpl,gpl-3.0", 1.0), 2: (3, 0, "", 0.0), 3: (2, 0, "", 0.0)}

"""The ten operators on small tables: brute force, round trips, and the edge cases that their docstrings define."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import arrowfile, chat, common, components, extract, imatch, language, lmscore, media, mixing, packing, queries, simjoin
from quern.llm.tokens import Encoder
from tests import oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i}" for i in range(3000))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "a b c d e f g.", "en", "s", 1), (2, None, "en", None, 1), (3, "", None, "s", None), (4, LONG, "de", "t", 1), (1, "a b c d e f g.", "en", "s", 1), (None, "x  y\tz", None, "t", 1), (7, "<|endoftext|> \\ <s> é", "en", None, 2), (8, "a b c d  e f g.", "de", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("bucket", "node", "rid", "word", "h", "u", "size", "copies")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return common.documents(spark, data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, data, name):
    oracle.check(spark, data, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("file, lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder(file, lower, docs):
    e = Encoder(P.path(file), lower)
    texts = [r["text"] for r in docs.limit(150).collect()] + ["a \n b  c\n\n d ", "  x", "İstanbul Σας's don't x", "é <|endoftext|> x\ty", "", " ", "\n", " \n x", "x \n", "naïve,it's;a|b", "…—“q”", "éa b", "x y ​"]
    plain = Tokenizer.from_file(P.path(file))
    for t in texts:
        assert e.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, docs, edge, empty):
    for df in (docs, edge, empty):
        folder = common.scratch(spark, "test-shards")
        manifest = common.settle(arrowfile.write_shards(df, folder, P.path("word_bpe_49k.json"), lower=True, length=64), "test-manifest")
        got = sorted(map(tuple, arrowfile.read_shards(manifest).collect()), key=lambda r: r[1])
        plain, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        assert len(got) == len(rows)
        for g, (doc_id, text) in zip(got, rows, strict=True):
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
            assert g == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        for r in manifest.collect():
            shard = arrowfile.ShardReader(r["uri"])
            n = sum(int(shard.sequence(i)[1].sum()) for i in range(-(-r["n_tokens"] // 64)))
            assert n == r["n_tokens"]
            assert not shard.sequence(0)[0].flags.owndata


def test_packing(spark, docs, edge, empty):
    for df, tight in ((docs, True), (edge, False), (empty, False)):
        got = packing.pack(df, P.path("byte_bpe_50k.json")).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in got:
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
            by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        for parts in by_seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        want = Counter()
        for r in df.collect():
            want[r["doc_id"]] += len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert {d: sum(n for _, n, _ in x) for d, x in by_doc.items()} == dict(want)
        if tight:
            assert sum(r["length"] for r in got) / (1024 * len(by_seq)) > 0.95


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(5)
    length = np.exp(rng.normal(6.6, 1.0, 100_000)).astype(int) + 2
    demand = {int(c): int(n) for c, n in Counter((-(-(length % 1024) // 4)).tolist()).items() if c}
    plan = packing.plan(demand, 256)
    held = Counter()
    for p, times in plan:
        assert sum(c * n for c, n in p.items()) <= 256
        for c, n in p.items():
            held[c] += n * times
    assert held == Counter(demand)
    # No plan can do better than the sum of sizes.
    bound = sum(c * n for c, n in demand.items()) / 256
    assert sum(t for _, t in plan) <= 1.03 * bound


def brute(df):
    rows = [(r["doc_id"], frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()) for r in df.collect() for w in [(r["text"] or "").encode().split()]]
    alike = lambda a, b: (len(a & b) >= 0.8 * len(a | b)) if a or b else True
    links = [[j for j, y in enumerate(rows) if j != i and alike(x[1], y[1])] for i, x in enumerate(rows)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    return sorted(((rows[i][0], least[label[i]], len(links[i])) for i in range(len(rows))), key=repr)


def test_jaccard_join(spark, docs, edge, empty):
    for df in (docs, edge, empty):
        assert sorted((tuple(r) for r in simjoin.join(df).collect()), key=repr) == brute(df)


def test_jaccard_join_of_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]]), None, None, 0) for i in range(330)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in simjoin.join(df).collect()), key=repr) == brute(df)


def settled(monkeypatch, seen):
    """Calls seen(name, table, written table) for each table that is settled."""
    real = common.settle

    def settle(df, name, **watch):
        out = real(df, name, **watch)
        seen(name, df, out)
        return out

    monkeypatch.setattr(common, "settle", settle)


def test_links_of_a_large_group_do_not_multiply(spark, monkeypatch):
    """A group's candidate links are a few for each of its rows, by however many nodes it goes; strangers that share a passage with it are kept apart."""
    base, links = [f"w{i}" for i in range(120)], []
    rows = [(i, " ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]]), None, None, 0) for i in range(600)]
    rows += [(i, " ".join([*base[:30], *(f"y{i}-{k}" for k in range(90))]), None, None, 0) for i in range(600, 900)]
    settled(monkeypatch, lambda name, _, out: links.append(out._watched["rows"]) if name == "join-links" else None)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in simjoin.join(df).collect()), key=repr) == brute(df)
    assert max(links) <= 4 * len(rows)


def test_nodes_hold_the_sketches_they_are_compared_with(spark, monkeypatch):
    """The table of sketches is joined once, not again at each depth for the first row of each node."""
    base, again = [f"w{i}" for i in range(120)], []
    rows = [(i, " ".join([*base[:30], *(f"y{i}-{k}" for k in range(90))]), None, None, 0) for i in range(1200)]
    settled(monkeypatch, lambda name, df, _: again.append(any("/join-reps-" in f for f in df.inputFiles())) if name == "join-nodes" else None)
    simjoin.join(spark.createDataFrame(rows, SCHEMA))
    assert len(again) > 1 and not any(again)


def test_near_duplicates_leave_texts_in_place(spark, data, docs):
    """The pipeline's second stage neither hashes nor shuffles the texts again to drop its rows."""
    import corpus_pipeline as cp

    plan = cp.drop_near_duplicates(spark, docs, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan


def test_shingles_against_words():
    """Equal words in a row give equal hashes, different ones different hashes, wherever they stand and however they are spaced."""
    texts = ["a b c d e f", "  a  b\tc d e\n", "", " ", "a b c d", "a b c d e f", "b c d e f", "ab c d e f", "é\x1c b c d e", "é b c d e"]
    of = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().split()] if w for i in range(max(1, len(w) - 4))}
    got = simjoin.shingles([t.encode() for t in texts])
    for t, h in zip(texts, got, strict=True):
        assert len(h) == len(of(t)) and (np.diff(h.astype(object)) > 0).all()
        for other, g in zip(texts, got, strict=True):
            assert len(np.intersect1d(h, g)) == len(of(t) & of(other)), (t, other)


def test_sketch_loses_no_small_pair():
    """Sets of ten to a thousand tokens at the threshold: their sketches agree beyond the limit of their size."""
    rng = np.random.default_rng(7)
    for n in (10, 20, 40, 80, 300, 1000):
        lost = 0
        for _ in range(300):
            common_ = rng.integers(1, 2**63, round(n * 8 / 9), np.uint64)
            a, b = (np.unique(np.concatenate([common_, rng.integers(1, 2**63, n - len(common_), np.uint64)])) for _ in range(2))
            lost += (simjoin.sketch(a) == simjoin.sketch(b)).mean() < simjoin.loose(np.array([n]))[0]
        assert lost <= 1, (n, lost)


def test_join_goes_on_until_the_recall(spark, docs, monkeypatch):
    """With chosen paths that hardly ever meet, runs go on until the measured recall is there."""
    monkeypatch.setattr(simjoin, "BRANCH", 0.3)
    calls, real = [], simjoin.recall
    monkeypatch.setattr(simjoin, "recall", lambda *a: calls.append(real(*a)) or calls[-1])
    got = sorted((tuple(r) for r in simjoin.join(docs).collect()), key=repr)
    assert calls[-1] >= simjoin.TARGET and len(got) == docs.count()


def test_join_ends_on_sketches_that_agree_by_chance(spark, monkeypatch):
    """Sets of one shingle whose sketches are equal though they share no token can't be tied by any run and don't count as missed."""
    texts = [f"k{i} one" for i in range(300)]
    kept = [simjoin.sketch(x).tobytes() for x in simjoin.shingles([t.encode() for t in texts])]
    assert len(set(kept)) < 250
    calls, real = [], simjoin.recall
    monkeypatch.setattr(simjoin, "recall", lambda *a: calls.append(real(*a)) or (calls[-1] if len(calls) < 3 else 1.0))
    near = [" ".join([*(f"w{i}" for i in range(100)), f"x{k}"]) for k in range(3)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate([*texts, *near])], SCHEMA)
    got = sorted(tuple(r) for r in simjoin.join(df).collect())
    assert got == [(i, i, 0) for i in range(300)] + [(i, 300, 2) for i in range(300, 303)]
    assert calls == [1.0]


def test_recall_counts_true_pairs_only(spark):
    """One pair at the threshold or more lies in two classes, one in one class; a third pair agrees by its sketches alone."""
    texts = ["a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n o p", "q r s t u v w x y z 1 2 3 4 5", "q r s t u v w x y z 1 2 3 4 5 6", *(f"k{i} one" for i in range(300))]
    df = common.settle(simjoin.represent(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)), "test-rows")
    rid = {r["doc_id"]: r["rid"] for r in df.collect()}
    group = spark.createDataFrame([(rid[0], rid[0]), (rid[1], rid[0])], "node long, root long")
    asked = df.filter("doc_id < 104")
    assert simjoin.recall(asked.select("rid", "n", "sketch"), df, group) == 0.5


def _odd_ids(spark):
    """Near duplicates under null ids; different texts under one id and under none; copies of a row."""
    text = lambda p, x=0: " ".join([*(f"{p}{i}" for i in range(80)), f"x{x}"])
    rows = [(None, text("a", 0)), (None, text("a", 1)), (None, text("b")), (5, text("c", 0)), (5, text("d")), (6, text("c", 1)), (5, text("e")), (5, text("e")), (None, text("b"))]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def test_jaccard_join_of_null_ids(spark):
    df = _odd_ids(spark)
    assert sorted((tuple(r) for r in simjoin.join(df).collect()), key=repr) == brute(df)


def test_pipeline_keeps_rows_of_odd_ids(spark, data):
    import corpus_pipeline as cp

    out = common.settle(cp.drop_near_duplicates(spark, _odd_ids(spark), data), "test-odd")
    got = sorted((r["doc_id"] or 0, r["text"][0]) for r in out.collect())
    assert got == [(0, "a"), (0, "b"), (5, "c"), (5, "d"), (5, "e")]
    mixed = Counter((r["doc_id"], r["text"]) for r in cp.mix_sources(spark, out, data).collect())
    assert set(mixed.values()) <= {1, 2} and 1 <= len(mixed) <= 5


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got[i] for i in range(61)) == {0} and got[200] == got[150] == 100


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    settled(monkeypatch, lambda name, *_: rounds.append(name))
    order = np.random.default_rng(7).permutation(4000).tolist()
    links = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(4000)}
    assert len(rounds) <= 6


def test_components_of_few_links_take_no_round(spark, monkeypatch):
    """Links of whole paths over many tasks end in one task while they are counted to be few, and in rounds beyond that."""
    tables, links = [], [(k * 1000 + i, k * 1000 + i + 1) for i in range(40) for k in range(20)]
    settled(monkeypatch, lambda name, *_: tables.append(name))
    df, want = spark.createDataFrame(links, "a long, b long").repartition(16), {(k * 1000 + i, k * 1000) for i in range(41) for k in range(20)}
    assert {tuple(r) for r in components.components(df).collect()} == want and len(tables) == 2
    monkeypatch.setattr(components, "HELD", 50)
    got = [tuple(r) for r in components.components(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(tables) > 4


def test_join_shuffles_few_tables(spark, monkeypatch):
    """On groups that go to the last depth, what is counted or compared at a depth is dealt once, not once for each kind of node."""
    base, dealt = [f"w{i}" for i in range(120)], []
    monkeypatch.setattr(simjoin, "BLOCK", 128)
    rows = [(i, " ".join([*base[:30], *(f"y{i}-{k}" for k in range(90))]), None, None, 0) for i in range(600)]
    rows += [(600 + i, " ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]]), None, None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    settled(monkeypatch, lambda name, t, _: dealt.append((name, t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))))
    assert sorted((tuple(r) for r in simjoin.join(df).collect()), key=repr) == brute(df)
    assert [name for name, _ in dealt].count("join-open") > 1 and max(n for name, n in dealt if name == "join-open") <= 2
    assert sum(n for _, n in dealt) <= 30, dealt


def waterfill(sizes, weights, budget):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing(spark, data, docs, edge, empty):
    runs = []
    for _ in range(2):
        out = queries.QUERIES["op4_mixing"](spark, data)
        runs.append(sorted(tuple(r) for r in out.collect()))
    assert runs[0] == runs[1]
    sizes, taken, target = Counter(), Counter(), {}
    for r in out.join(docs.select("doc_id", "source"), "doc_id").collect():
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = waterfill(sizes, (3, 1, 2), 1.5)
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in want)
    for s in want:
        assert taken[s] <= want[s] * (1 + 1e-9) + 1 and taken[s] >= 0.9 * want[s], (s, taken[s], want[s])
    # On a source whose target lies below its limit, the rates are the tilted ones and sum to the target.
    at = {r["s"]: r for r in mixing.state(common.settle(mixing.sizes(docs), "test-sizes"), (3, 1, 2), 1.5, 2).collect()}
    by = defaultdict(list)
    for r in docs.collect():
        by[r["source"]].append(len((r["text"] or "").encode().split()))
    for s, r in at.items():
        if r["target"] < 2 * r["source_size"]:
            have = sum(n * 2 / (1 + math.exp(-r["lam"] * n / r["scale"])) for n in by[s])
            assert math.isclose(have, r["target"], rel_tol=1e-3), s
    got = mixing.mixed(edge)
    assert got.columns[: len(edge.columns)] == edge.columns
    got = got.collect()
    assert len(got) == 8 and {r["_mix_copies"] for r in got if r["_mix_size"] == 0} == {0}
    fates = defaultdict(set)
    for r in got:
        fates[(r["doc_id"], r["text"])].add(r["_mix_copies"])
    assert all(len(x) == 1 for x in fates.values())
    assert mixing.mixed(empty).count() == 0


def test_mixing_draws_settle_a_table_a_round(docs, monkeypatch):
    """The driver plans and runs each table; the first draw has two rounds, the others one."""
    names = []
    settled(monkeypatch, lambda name, *_: names.append(name))
    mixing.mixed(docs)
    assert names.count("mix-cut") == 2 + len(mixing.FILLS)


def test_mixing_plans_do_not_double_by_draws(docs, monkeypatch):
    """Each draw adds to a plan what the one before did; written into each other, five took 115,000 characters."""
    length = lambda df: len(df._jdf.queryExecution().toString())
    most = []
    settled(monkeypatch, lambda name, df, _: most.append(length(df)))
    most.append(length(mixing.mixed(docs)))
    assert max(most) < 60_000


def test_language(spark, docs, edge, empty):
    held = common.crc_mod("doc_id", 4) == 2
    out = language.identify(docs.select("doc_id", "text", "lang"), ~held, keep=("doc_id",)).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", held).collect()
    tested = [r for r in out if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) > 0.9 * len(tested)
    got = language.identify(edge, F.lit(True), keep=("doc_id", "text")).collect()
    assert len(got) == 8 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if not any(map(str.isalpha, r["text"] or "")))
    assert language.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge, F.lit(False)).collect()} == {"und"}


def test_rejection_for_a_language_with_few_documents():
    words = {"de": "der die das und nicht eine haus wasser berg", "en": "the and not water house mountain every with", "fr": "le la les une maison eau montagne avec"}
    m = language.Models(sorted(words), [(words[x].split(), np.full(len(words[x].split()), 50)) for x in sorted(words)], 4)
    held = [(x, (words[x] + " ") * 2) for x in ("de", "en") for _ in range(6)] + [("fr", (words["fr"] + " ") * 2)]
    c = language.Calibration(sorted(words), held, m)
    assert np.isfinite(c.mean).all()
    e, n = language.Identifier(m).entropies(["qzx jjk vvwq xkcd zzzq pqpq wxyz kkjq " * 100, words["fr"] * 2])
    assert c.beyond(np.array([2, 2]), e[:, 2], n).tolist() == [True, False]


def test_kneser_ney_sums_to_one():
    m = language.Models(["x"], [(["ab", "abc", "ba"], np.array([3, 1, 2]))], order=3)
    one = [m.word_sums([w])[0, 0] for w in ("", "a", "b", "c", "ab", "abc", "zz")]
    assert all(p < 0 for p in one) and one[4] > one[6]


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>", "<<SYS>>é\n😀", "[[INST]", None]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c in range(2) for t, x in enumerate(nasty)] + [(5, None, None, "q"), (5, 1, "a\nb\\", "r"), (5, 1, "a\nb\\", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    got = out.withColumn("p", chat.parse_chats(F.col("formatted"))).withColumn("l", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in got:
        want = sorted([(t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["p"]] == [(a[2], a[3]) for a in want]
        assert r["l"] == "".join(a[3] for a in want if a[2] == "assistant")
        assert r["valid"] is (r["conv_id"] != 5)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_media(spark, docs, edge, empty):
    for df in (docs.limit(60), edge, empty):
        stored = common.settle(media.store_texts(df), "test-media")
        got = media.resolve(media.parse(stored.select("doc_id", "html")), media.describe(stored)).collect()
        want = Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            want[(r["doc_id"], f"{len(raw)} bytes", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
        assert Counter((r["doc_id"], r["caption"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    items = media.interleaved('<p>one<img src="media:x"><p>two<figure><img src="y"><figcaption>c &amp; d</figcaption></figure>')
    assert [(i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [("text", "one", None, None), ("media", None, "media:x", None), ("text", "two", None, None), ("media", None, "y", "c & d")]


def test_captions_stay_with_their_figure():
    page = "<img src=a alt=one><figure><figcaption>cap of b</figcaption><img src=b></figure><p>t</p><figure><img src=c><img src=d alt=x><figcaption>both</figcaption></figure><figcaption>loose</figcaption><figure><img src=e alt=own></figure><figure><img src=f><figcaption>cut"
    items = media.interleaved(page)
    assert [(i["ref"], i["caption"]) for i in items if i["kind"] == "media"] == [("a", "one"), ("b", "cap of b"), ("c", "both"), ("d", "both"), ("e", "own"), ("f", "cut")]
    assert [i["text"] for i in items if i["kind"] == "text"] == ["t", "loose"] and [i["pos"] for i in items] == list(range(len(items)))


def test_extract(spark):
    page = "<html><head><title>T</title><script>x('</p>')</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>One.<p>Two <b>bold<br>more</p><div class='ad'>Buy</div><aside>Side</aside></article><section id=comments><p>Reader says a long thing here, and it goes on.</p></section><footer>&copy; x</footer>"
    assert extract.main_text(page) == "Head & line\nOne.\nTwo bold more"
    assert extract.main_text(None) == extract.main_text("") == ""
    assert extract.main_text("<article><p>cut &am") == "cut &am"
    plain = "<body><div class='sidebar'>links</div><div><p>This is a long paragraph of true content which has many words, and it ends well.</p><p>Short one.</p></div><p>© Foo</p></body>"
    assert extract.main_text(plain).startswith("This is") and "links" not in extract.main_text(plain)
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", page)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in extract.extract(df).orderBy("page_id").collect()] == [0, 0, 30]


@pytest.mark.parametrize("wrap", ["<div class='page has-sidebar'>", "<div id='main' class='with-nav'>", "<div class='site-menu'>"])
def test_extract_in_a_wrapper_of_boilerplate_words(wrap):
    page = f"{wrap}<nav>Home</nav><article><h1>Head</h1><p>One <math><mi>x</mi></math> two.</p><noscript><p>Plain.</p></noscript></article><div class='sidebar'>links</div></div>"
    assert extract.main_text(page) == "Head\nOne x two.\nPlain."


def test_extract_lets_the_cut_outvote_a_class_word():
    long = "This is a long paragraph of true content which has many words, and it ends well. " * 3
    page = f"<div><p>{long}</p><p class='post-notice'>{long}</p><p>{long}</p><p class='ad'>Buy</p></div>"
    assert extract.main_text(page).count("\n") == 2 and "Buy" not in extract.main_text(page)


def test_minimum_cut_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        unary = [tuple(x) for x in rng.random((n, 2))]
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: sum(u[0 if k else 1] for u, k in zip(unary, keep, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(extract.minimum_cut(unary, edges)), best, abs_tol=1e-9)


def test_imatch_edges(spark, edge, empty):
    rows = imatch.with_next(edge).filter("NOT extra")
    assert rows.count() == 8
    assert imatch.with_next(empty).count() == imatch.fingerprints(empty).count() == 0
    order = [(None, "x  y\tz"), (1, "a b c d e f g."), (1, "a b c d e f g."), (2, ""), (3, ""), (4, LONG), (7, "<|endoftext|> \\ <s> é"), (8, "a b c d  e f g.")]
    got = {(r["doc_id"], r["text"], r["next_text"]) for r in rows.collect()}
    assert got == {(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    out = imatch.fingerprints(edge).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert len(out) == 8 and len(by[1]) == 2
    assert by[1][0]["fingerprint"] == by[1][1]["fingerprint"] == by[8][0]["fingerprint"]
    assert by[2][0]["fingerprint"] == by[3][0]["fingerprint"] == imatch.NONE * (len(imatch.RATES) + 1) and by[2][0]["near_next"] == 1.0
    assert len({r["fingerprint"] for r in out}) == 5
    assert all(len(r["fingerprint"]) == 8 * (len(imatch.RATES) + 1) for r in out)
    edited = {r["doc_id"]: r["edited_sha256"] for r in out}
    assert edited[7] == hashlib.sha256(("<|endoftext|> \\ <s> é"[:-5] + "a b c").encode()).hexdigest()


def test_imatch_looks_up_alike_beyond_the_check(spark, docs):
    lex = imatch.lexicon(docs)
    rows = docs.limit(40).select(F.lit(1).alias("bucket"), F.col("doc_id").alias("pos"), "text", F.reverse("text").alias("edited"))
    near, far = ([tuple(r) for r in imatch.add_prints(rows, lex, within).orderBy("pos").collect()] for within in (common.BROADCAST_BYTES, 0))
    assert near == far and len({r[2] for r in near}) > 30


def test_imatch_of_one_id(spark):
    """All rows under a few ids or none: ranges are cut by the text hash, and each row's next is the next by hash."""
    rows = [(None if i % 3 else 5, f"w{i} common {i % 7}", "en", "s", 1) for i in range(400)]
    got = imatch.with_next(spark.createDataFrame(rows, SCHEMA)).filter("NOT extra").collect()
    order = sorted([(r[0] or -1, hashlib.md5(r[1].encode()).hexdigest(), r[1]) for r in rows])
    assert {(r["text"], r["next_text"]) for r in got} == {(a[2], b[2]) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert len({r["bucket"] for r in got}) > 4
    lone = imatch.fingerprints(spark.createDataFrame([(1, "only one here", "en", "s", 1)], SCHEMA)).collect()
    assert [r["near_next"] for r in lone] == [1.0]


def test_imatch_texts_without_band_terms_differ(spark):
    df = spark.createDataFrame([(1, "the one", "en", "s", 1), (2, "the two", "en", "s", 1), (3, "the", "en", "s", 1)], SCHEMA)
    got = imatch.fingerprints(df).orderBy("doc_id").collect()
    assert len({r["fingerprint"] for r in got}) == 3 and got[0]["near_next"] < 1


def test_lattice_sums_all_segmentations():
    pieces = {"▁": math.log(0.2), "a": math.log(0.1), "▁a": math.log(0.3), "ab": math.log(0.2), "b": math.log(0.1)}
    want = 0.2 * 0.1 * 0.1 + 0.2 * 0.2 + 0.3 * 0.1
    assert math.isclose(10 ** lmscore.Lattice(pieces, -20.0).log10(["ab"])[0, 0], want)


@given(st.lists(st.text("abé▁\0\U0001f600", min_size=1, max_size=9), min_size=1, max_size=6))
@settings(max_examples=30, deadline=None)
def test_lattice_against_all_segmentations(words):
    models = [{"▁": -1.5, "a": -2.0, "▁a": -1.0, "ab": -1.5, "b": -2.0, "aba": -2.5}, {"▁": -2.5, "a": -1.0, "▁a": -2.0, "ab": -3.5, "b": -1.0, "aba": -0.5}]
    byte = -4.0

    def ways(s, m):
        """(probability, pieces) of each segmentation."""
        if not s:
            yield 1.0, ()
        for j in range(1, len(s) + 1):
            p = m.get(s[:j], byte * len(s[0].encode()) if j == 1 else None)
            if p is not None:
                yield from ((math.exp(p) * q, (s[:j], *r)) for q, r in ways(s[j:], m))

    got, uses = lmscore.Lattice(models, byte).log10(words), Counter()
    for w, row in zip(words, got, strict=True):
        for g, m in zip(row, models, strict=True):
            assert math.isclose(g, math.log10(sum(q for q, _ in ways("▁" + w, m))), rel_tol=1e-9)
        total = sum(q for q, _ in ways("▁" + w, models[0]))
        for q, r in ways("▁" + w, models[0]):
            for piece in r:
                uses[piece] += q / total
    expected = lmscore.Lattice(models[0], byte).expected(words)
    assert all(math.isclose(e, uses[p], abs_tol=1e-9) for p, e in zip(models[0], expected, strict=True))


def test_lattice_of_a_very_long_word():
    got = lmscore.Lattice({"▁": -1.0, "a": -2.0}, -4.0).log10(["a" * 20_000, "a"])
    assert np.allclose(got[:, 0] * math.log(10), [-40_001.0, -3.0])


def test_vocabulary_is_whole():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    got = lmscore.vocabulary(P.path("piece_bpe_32k.model"))
    assert set(got) == {p for p in want if p and "▁" not in p[1:]} and "▁information" in got
    lattice = lmscore.Lattice(got, lmscore.BYTE)
    assert lattice.longest == max(map(len, got)) > 10
    # A word that is one piece has at least that piece's probability.
    assert lattice.log10(["information"])[0, 0] * math.log(10) > got["▁information"]


def test_pieces_are_fitted_on_all_words(spark):
    # More types than the sample that once fitted them, and one longer than it took.
    words = [f"w{i}x" for i in range(12_000)] + ["q" * 70]
    counts = spark.createDataFrame([(w, 1 + i % 3, i % 2) for i, w in enumerate(words)], "word string, c0 long, c1 long").repartition(3)
    pieces = {p: -3.0 for p in ["▁w", "▁", "q", "qq", "x", *"0123456789", *(f"{i}{j}x" for i in range(10) for j in range(10))]}
    got = lmscore.fit(counts, ["c0", "c1"], pieces, rounds=1)
    for k, weight in enumerate((lambda i: 1 + i % 3, lambda i: i % 2)):
        uses, lattice = np.full(len(pieces), 1e-3), lmscore.Lattice(pieces, lmscore.BYTE)
        for w in range(6):  # words of one weight
            uses += weight(w) * lattice.expected([x for i, x in enumerate(words) if i % 6 == w])
        want = np.log(0.98 * uses / uses.sum())
        assert np.allclose([got[k][p] for p in pieces], want)
    assert got[0]["q"] > -12


def test_lm_score(spark, docs, edge, empty):
    got = lmscore.score(docs, P.path("piece_bpe_32k.model")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {d: [w for w in (t or "").encode().lower().split()] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    c = Counter(w for d, ws in words.items() if not held[d] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = [*words[r["doc_id"]], None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    assert lmscore.score(edge, P.path("piece_bpe_32k.model")).count() == 8
    assert lmscore.score(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline as cp

    docs = common.documents(spark, data)
    for name, stage in cp.STAGES[:-1]:
        out = common.settle(stage(spark, docs, data), f"test-{name}")
        assert out.columns == cp.COLUMNS
        if name != "mixing":
            assert out.count() == out.select("doc_id").distinct().count() > 0
            assert docs.count() >= out.count() > 0.7 * docs.count()
        docs = out
    assert not any(n for _, _, n in brute(docs.dropDuplicates(["doc_id"])))

"""Operators over groups of documents: near duplicates, repeats, mixing and conversations."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wickline.llm import chat, components, mixing, phrases, repeats, simhash, suffixes

from .conftest import DDL

# ------------------------------------------------------------ near duplicates


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("chain", [1, 2, 3, 4, 5])
def test_keys_cover_every_link(chain):
    rng = random.Random(chain)
    masks = simhash.key_masks(chain=chain)
    for _ in range(4000):
        a = b = rng.getrandbits(64)
        for k in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 4, 4])):
            b ^= 1 << k
        assert any((a ^ b) & m == 0 for m in masks)
        assert simhash.within(np.array([a], np.uint64), np.array([b], np.uint64))[0]


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_forest_keeps_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (500, 3), dtype=np.uint64), axis=1) for b in base]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    brute = roots([(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near)) if i < j], fps.tolist())
    for block in (64, 4096):
        edges = simhash.forest(fps, 4, block)
        assert len(edges) < len(fps)
        assert roots(edges, fps.tolist()) == brute


def test_near_duplicates(spark, docs, odd_rows, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(odd_rows)
    prints = [(r[0], brute_fingerprint(r[1])) for r in odd_rows]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4]
    root = roots(pairs, range(len(prints)))
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root[k]] = min(doc_id, least.get(root[k], doc_id))
    expected = sorted((str(d), f - (1 << 64) if f >> 63 else f, least.get(root[k])) for k, (d, f) in enumerate(prints))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in found) == expected
    assert simhash.near_duplicates(empty).collect() == []


def brute_copies(texts):
    """The group number of each text: components at 5-word Jaccard 0.8."""
    sets = []
    for text in texts:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = roots(near, range(len(sets)))
    return [root[k] for k in range(len(sets))]


def edited_texts(seed):
    """Texts with one to four words of a hundred changed, a large group of them, and one line in very many."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randint(0, 3000)}" for _ in range(k)]
    line = words(30)
    out = [" ".join(line + words(rng.randint(1, 40))) for _ in range(60)]
    for copies in (2, 3, 3, 60):
        base = words(100)
        for _ in range(copies):
            own = list(base)
            for k in rng.sample(range(100), rng.randint(0, 4)):
                own[k] = "edit" + str(rng.randint(0, 9))
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed, hot", [(1, 8), (2, 2), (3, 10**6)])
def test_stage_groups_are_those_of_jaccard(spark, odd_rows, monkeypatch, seed, hot):
    monkeypatch.setattr(simhash, "HOT_COUNT", hot)
    texts = edited_texts(seed) + [r[1] for r in odd_rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = brute_copies(texts)
    least = {}
    for k, g in enumerate(group):
        least.setdefault(g, k)
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == sorted(least.values())


def test_stage_keeps_one_row_a_group(spark, odd_rows):
    copy = "a copy that many rows of this table hold in their text"
    rows = [
        *odd_rows,
        (None, "only null ids hold this text", "en", "s1", 28),
        (None, "only null ids hold this text", "en", "s2", 28),
        (None, "a clean row without an id", "en", "s1", 25),
        (600, copy, "en", "s1", 54),
        (600, copy, "en", "s1", 54),
        (601, copy, "en", "s1", 54),
        (601, "another text of the same id as a copy", "en", "s1", 37),
        (None, copy, "en", "s1", 54),
    ]
    group = brute_copies([r[1] for r in rows])
    least = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[group[k]] = min(least.get(group[k], (key, r[0])), (key, r[0]), key=lambda x: x[0])
    got = simhash.stage(spark, spark.createDataFrame(rows, DDL).repartition(3), "").collect()
    texts = {}
    for k, r in enumerate(rows):
        texts.setdefault(r[1], group[k])
    assert sorted(texts[r.text] for r in got) == sorted(least)
    assert all(r.doc_id == least[texts[r.text]][1] for r in got)


def test_stage_links_by_fingerprints(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(20)]
    texts += [t.replace("x150 ", "changed ") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints = [simhash.print_of(found) for found in simhash.ShingleSets(simhash.STAGE_SHINGLE)([t.encode() for t in texts])]
    linked = {k for k in range(20) if (prints[k] ^ prints[k + 20]).bit_count() <= simhash.STAGE_TAU}
    assert len(linked) > 10
    exact, links = simhash.candidate_pairs, simhash.linked_sets
    monkeypatch.setattr(simhash, "candidate_pairs", lambda *args: exact(*args).limit(0))
    assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == set(range(40)) - {k + 20 for k in linked}
    # What fingerprints have linked is not a candidate again, the rest is.
    seen = []
    monkeypatch.setattr(simhash, "candidate_pairs", lambda *args: seen.append(exact(*args)) or seen[-1])
    monkeypatch.setattr(simhash, "tables", lambda spark: lambda *keep: None)
    assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == set(range(20))
    assert seen[0].count() == 20 - len(linked)
    assert links(spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "head long, fp long")).count() == 2


def test_few_edges_take_one_task_and_many_the_rounds(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1300)] + [(None, 3), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = sorted(components.connected(table).collect())
    assert sorted(components.joined(table).collect()) == want
    monkeypatch.setattr(components, "ONE_TASK", 10)
    assert sorted(components.joined(table).collect()) == want
    assert components.joined(table.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(0)
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = path + star + [(5000, 5000), (7000, 6999), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}, 7000: 6999, 6999: 6999}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------ repeats


def brute_bytes(rows):
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(-(1 << 63) if doc_id is None else doc_id, []).append((text or "").encode())
    first, out = {}, []
    for d in sorted(texts):
        for b in texts[d]:
            for i in range(len(b) - 49):
                first.setdefault(b[i : i + 50], d)
    for d in texts:
        for b in texts[d]:
            gone = bytearray(len(b))
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
            spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
            out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def hard_rows(seed):
    """Periodic texts, copies, shared passages at all offsets, and passages of just the window's length."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.choice([49, 50, 51, 70, 200]))) for _ in range(8)] + ["ab" * 60, "a" * 130, "xyz" * 40]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 30) :] + rng.choice(["", "-", str(rng.random())]) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    return rows + [(3, rows[3][1]), (None, pool[4]), (200, None), (201, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_bytes(spark, seed):
    rows = hard_rows(seed)
    found = suffixes.duplicate_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    got = sorted((str(-(1 << 63) if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == brute_bytes(rows)
    for r in found:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans


def test_duplicate_bytes_of_odd_documents(docs, odd_rows, empty, clashing):
    got = sorted((str(-(1 << 63) if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.duplicate_bytes(clashing).collect())
    assert got == brute_bytes([r[:2] for r in odd_rows])
    assert suffixes.duplicate_bytes(empty).collect() == []


def test_refinement_orders_windows_exactly():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8), np.zeros(80, np.uint8)])
    at = np.sort(rng.choice(2900, 800, replace=False))
    ids = suffixes.refine(text, at, 50)
    raw = text.tobytes()
    seen = {}
    for i, b in zip(at.tolist(), ids.tolist()):
        assert seen.setdefault(raw[i : i + 50], b) == b
    assert len(set(seen.values())) == len(seen)


def brute_words(rows):
    docs = [(-(1 << 63) if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in sorted(docs, key=lambda x: x[0]):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def word_rows(seed):
    rng = random.Random(seed)
    words = "a b c dd é f".split()
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([19, 20, 21, 45]))) for _ in range(7)] + [" ".join(["w"] * 60), " ".join(["p", "q"] * 30)]
    rows = [(i, " ".join(" ".join(rng.choice(pool).split()[rng.randint(0, 9) :]) + rng.choice(["", f" {rng.random()}"]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    return rows + [(3, rows[3][1]), (None, pool[4]), (200, None), (201, " \t")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_phrases(spark, seed):
    rows = word_rows(seed)
    found = phrases.repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(-(1 << 63) if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_words(rows)


def test_repeated_phrases_of_odd_documents(odd_rows, empty, clashing):
    got = sorted((str(-(1 << 63) if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in phrases.repeated_phrases(clashing, texts=False).collect())
    assert got == brute_words([r[:2] for r in odd_rows])
    assert phrases.repeated_phrases(empty).collect() == []


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    rows = np.zeros(100, repeats.OCC)
    rows["key"] = rng.integers(0, 1 << 48, 100)
    rows["doc"] = np.sort(rng.integers(-(1 << 62), 1 << 62, 100))
    rows["first"], rows["n"] = rng.integers(0, 1 << 20, 100), 7
    assert (repeats.unpack(repeats.pack(rows), repeats.OCC) == rows).all()
    assert len(repeats.unpack(repeats.pack(rows[:0]), repeats.OCC)) == 0
    texts = [b"", b"a\0b", b"xyz" * 50]
    assert repeats.unpack_texts(repeats.pack_texts(texts)) == texts


# ------------------------------------------------------------ mixing


def taken_of(spark, docs):
    spans, sources, _ = mixing.mix(mixing.counted(docs), block=8, shard=16)
    return mixing.taken_words(docs, block=8, shard=16).collect(), spans, {r.source: r for r in sources.collect()}


def test_mixing(spark, docs, odd_rows, empty):
    out, spans, sources = taken_of(spark, docs)
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(r[0]), len((r[1] or "").encode().split())) for r in odd_rows)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len((r[1] or "").encode().split()) for r in odd_rows if r[3] == s) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.sid] = taken.get(r.sid, 0) + r.taken
    for k, s in enumerate(order):
        target = 2 * sizes[s] if s in capped else level * weight[s]
        assert sources[s].source_size == sizes[s] and sources[s].target == pytest.approx(target)
        assert abs(taken[k] - target) <= 0.5
    again, _, _ = taken_of(spark, docs.repartition(7))
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert taken_of(spark, empty)[0] == []
    shards = spans.where("shard IS NOT NULL").select("shard", "sid", "block", "pass").distinct().groupBy("shard").count().collect()
    assert all(r["count"] <= 16 for r in shards)


def test_op1_keeps_rows_and_meets_small_targets(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return mixing.op1_mixing_sources(spark, f"{tmp_path}/{name}").collect()

    rows = [(1, "", "a"), (1, "", "a"), (2, None, "a"), (2, None, "a"), (None, "p q", "a"), (None, "p q", "a"), (3, "x y z", "a"), (3, "u", "a")]
    assert len(run(rows, "ties")) == len(rows)
    for n in (1, 70, 100, 131):
        for r in run([(i, " ".join(["w"] * n), s) for i, s in enumerate("abc")], f"n{n}"):
            assert abs(r.taken - r.target) <= 0.5 and r.taken <= 2 * r["size"]


def test_dedup_rests_on_the_methods(spark):
    from wickline.llm import repeats

    rows = spark.createDataFrame(hard_rows(1), "doc_id long, text string")

    def none(contexts, groups, n, weights):
        return np.full(int(n.sum()), -1, np.int64)

    found = repeats.find(rows, repeats.Bytes(suffixes.WINDOW, suffixes.ANCHOR), none, False, suffixes.DIGEST, suffixes._digest)
    assert {r.n_removed for r in found.collect()} == {0}

    def blind(members, runs, texts, units, by_place):
        whole, phrases.automata = phrases.automata, lambda found: iter(())
        try:
            return phrases.locate(members, runs, texts, units, by_place)
        finally:
            phrases.automata = whole

    rows = spark.createDataFrame(word_rows(1), "doc_id long, text string")
    found = repeats.find(rows, repeats.Words(phrases.WINDOW, phrases.ANCHOR), phrases.confirm, True, phrases.DIGEST, phrases._digest, blind)
    assert {r.n_removed for r in found.collect()} == {0}


def test_permutations_permute(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_mixed_documents_have_the_taken_words(spark, docs):
    out, _, sources = taken_of(spark, docs)
    mixed = mixing.mixed_documents(docs, block=8, shard=16)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert words == sum(r.taken for r in out)


# ------------------------------------------------------------ conversations

MESSAGES = [
    (1, 0, "user", "Hello there.\n\nHow are you?"),
    (1, 1, "bot", "> How are  YOU?\nfine"),
    (1, 2, "user", "On Monday x wrote:\n>> how are you?\n> fine\nthanks\n> nothing known"),
    (1, 3, "user", "> Hello there.\nagain"),
    (1, 4, "b", "tail"),
    (2, 0, "user", "> fine\nquoting another"),
    (2, 5, "bot", ""),
    (2, 7, "bot", None),
    (3, 1, "u", "> > deep\n>  \nno"),
    (3, 1, "u", "dup"),
    (4, 2000, "u", "late"),
    (4, 1, "u", "early"),
]


def test_quotes_make_threads(spark):
    rows = [*MESSAGES, (None, 1, "u", "> fine\nlost"), (5, None, "u", "no turn")]
    out = {(r.conv_id, r.turn, r.body): r for r in chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(rows)
    last = out[(1, 2, "thanks")]
    assert (last.n_quotes, last.n_linked, last.parent_turn, last.reply_depth) == (3, 2, 1, 2)
    assert out[(1, 3, "again")].parent_turn == 0 and out[(1, 4, "tail")].reply_depth == 2
    assert out[(2, 0, "quoting another")].n_linked == 1 and out[(2, 0, "quoting another")].parent_turn is None
    assert out[(4, 2000, "late")].parent_turn == 1
    assert out[(None, 1, "lost")].reply_depth == 0 and out[(5, None, "no turn")].parent_turn is None
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.reply_ordered(empty).collect() == []


QUOTING = [
    (1, 0, "u", "one a\ntwo b\nthree c\n\npara d\n\npara e"),
    (1, 1, "u", "other"),
    (1, 2, "u", "> One a\n> two  b\nsome lines"),
    (1, 3, "u", "> para d\n>\n> para e\nsome paragraphs"),
    (1, 4, "u", "> two b\n> para d\nnot consecutive"),
    (1, 5, "u", "> one a two b three c\n>> other\n> other\nwrapped anew"),
    (2, 0, "u", "> shared words\nearly"),
    (2, 1, "u", "shared words"),
    (3, 5, "u", "shared words"),
    (None, 0, "u", "lost words"),
    (None, 0, "u", "> lost words\nnowhere"),
    (4, 0, "u", "lost words"),
    (5, 0, "u", "> lost words\nfound"),
    (6, None, "u", "> lost words\nno turn"),
    (7, 0, "u", "> first\n>> second\n> third\n>>> first"),
    (7, 3, "u", "first"),
]


def test_quotes_of_some_lines_and_of_other_holders(spark):
    found = chat.reply_ordered(spark.createDataFrame(QUOTING, "conv_id long, turn long, role string, text string")).collect()
    out = {r.body: (r.n_linked, r.parent_turn) for r in found}
    assert len(found) == len(QUOTING)
    assert out["some lines"] == (1, 0) and out["some paragraphs"] == (1, 0) and out["not consecutive"] == (0, 3)
    assert out["early"] == (1, None) and out["found"] == (1, None) and out["nowhere"] == (0, None)


def test_a_link_outlives_the_quoting_conversation(spark):
    rows = [(1, 0, "u", "> shared words"), (1, 1, "u", "shared words"), (2, 0, "u", "shared words")]
    found = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.n_linked for r in found} == {(1, 0): 1, (1, 1): 0, (2, 0): 0}


@pytest.mark.parametrize("messages", [MESSAGES, QUOTING])
def test_quotes_against_sql(spark, messages):
    conversations = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "body_sha256", "n_quotes", "n_linked", "parent_turn", "thread_turn", "reply_depth", "position"]
    got = chat.reply_ordered(conversations).withColumn("body_sha256", F.sha2("body", 256)).select(*names).collect()
    import pyarrow as pa

    conversations = pa.table(  # noqa: F841  read by name below
        {c: pa.array([m[k] for m in messages], t) for k, (c, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}
    )
    found = duckdb.sql(chat.ORACLE_SQL)
    want = [tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_very_long_quote(spark):
    lines = [f"line {k}" for k in range(4000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join("> " * (1 + k % 2) + x for k, x in enumerate(lines))), (1, 2, "u", "\n".join("> " + x for x in lines))]
    found = {r.turn: r for r in chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1].n_quotes, found[1].n_linked, found[2].n_quotes, found[2].n_linked) == (4000, 4000, 1, 1)


def test_a_long_conversation(spark):
    rows = [(9, t, "u", f"m{t}") for t in range(2500)]
    out = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.position, r.reply_depth, r.thread_turn) for r in out) == [(t, t + 1, t, 0) for t in range(2500)]


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    from .conftest import rows

    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows(7, 80), DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i * 3, int(i % 7 == 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "no such words in any of these documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns
    kept = simhash.stage(spark, docs, folder)
    assert kept.count() < docs.count()
    assert corpus_pipeline.run(spark, folder).count() > 0

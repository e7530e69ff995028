"""Row-wise operators: decontamination, toxicity, quality, token counts and token files."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.llm import common, decontaminate, quality, token_counts, token_files, tokens, toxicity
from wickline.llm.common import fresh_path

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_id(df):
    return {(r.doc_id, r.text if "text" in r else None): r for r in df.collect()}


# ------------------------------------------------------------ decontamination


def brute_hits(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, owners = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            pattern = w[k : k + 10]
            for i in range(len(words) - len(pattern) + 1):
                if words[i : i + len(pattern)] == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    owners.add("" if item is None else str(item))
    return len(words), len(hit), sorted(owners)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 200])
def test_decontamination(spark, docs, odd_rows, part_bytes):
    texts = [r[1] for r in odd_rows if r[1] and len(r[1].split()) > 30]
    items = [(k, " ".join(t.split()[5:22])) for k, t in enumerate(texts[:6])] + [(90, "TWICE the same"), (91, ""), (92, None), (None, "a"), (90, "TWICE the same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench, part_bytes=part_bytes).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items)
        for s in r.hit_spans:
            assert WORD.findall(r.text.translate(LOWER)[s.start : s.end])
        assert sum(len(WORD.findall(r.text.translate(LOWER)[s.start : s.end])) for s in r.hit_spans) == r.n_hit


def test_decontamination_of_nothing(spark, docs, empty, clashing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench).collect()} == {0}
    some = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert decontaminate.digest(decontaminate.decontaminate(empty, some)).collect() == []
    assert decontaminate.digest(decontaminate.decontaminate(clashing, some)).count() == docs.count()
    row = decontaminate.digest(decontaminate.decontaminate(docs, bench)).first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated


# ------------------------------------------------------------ token counts and files


def odd_texts(n=3000):
    rng = random.Random(5)
    letters = list("ab Z.,'  \n\n\t#9é漢️́ \x1c　\x85\0\x01") + ["<|endoftext|>", "'s", " the", "<|startoftext|>", "ſ", "İ", "Σ"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


def test_prefix_counts_equal_the_library():
    path = tokens.public_path(token_counts.VOCABULARY)
    library, memo, rng = tokens.load(path), token_counts._memo(path), random.Random(1)
    texts = odd_texts(500) + ["it's we'RE 'store ''s x'r 'll' 'L a'v", "a" * 300, "!" * 70, "<|endoftext|>abc<|startoftext|>it's", "e\u0301e\u0300ab cafe\u0301s", "ß ẞ Σας ǅ Ⅷ ½"]
    for text in texts:
        table = token_counts.PrefixTable(text, memo.steps(tokens.blank_free_pieces(text)))
        want = [len(x.ids) for x in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert table.counts.tolist() == want
        budget = rng.randint(0, 12)
        assert table.truncate(budget) == text[: max(k for k, n in enumerate(want) if n <= budget)]
        assert table.fits(budget) == (want[-1] <= budget) and table.tokens_at(3) == want[min(3, len(text))]


def test_questions_need_no_encoder(monkeypatch):
    memo = token_counts._memo(tokens.public_path(token_counts.VOCABULARY))
    text = "x" * 4000 + " and some words"
    steps = memo.steps(tokens.blank_free_pieces(text))

    def refuse(*_):
        raise AssertionError("encoded again")

    monkeypatch.setattr(tokens, "load", refuse)
    monkeypatch.setattr(token_counts.Prefixes, "__call__", refuse)
    monkeypatch.setattr(token_counts.Prefixes, "_word", refuse)
    table = token_counts.PrefixTable(text, steps)
    assert table.tokens_at(len(text)) == table.n_tokens and len(table.truncate(table.n_tokens // 2)) < len(text)


def test_token_counts(spark, docs, empty, clashing, odd_rows):
    path = tokens.public_path(token_counts.VOCABULARY)
    library = tokens.load(path)
    rows = token_counts.count_tokens(docs, path).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) == token_counts.PrefixTable(r.text, r.prefix_steps).n_tokens
        assert len(r.prefix_steps) == len(r.text or "")
    assert token_counts.count_tokens(empty, path).collect() == []
    assert token_counts.count_tokens(clashing, path).count() == len(odd_rows)


def test_memo_stays_bounded():
    memo = tokens.Memo(tokens.load(tokens.public_path(token_counts.VOCABULARY)), len, limit=50)
    for k in range(20):
        memo.learn([[f"w{k}x{i}" for i in range(20)]])
        assert len(memo.known) <= 50


def test_encoding_equals_the_library():
    memo, _ = token_files._memo(tokens.public_path(token_files.VOCABULARY))
    texts = odd_texts()
    for text, found in zip(texts, token_files.encode(texts, memo)):
        assert np.frombuffer(found, "<u2").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_once_and_frequent_ones_stay():
    library = tokens.load(tokens.public_path(token_files.VOCABULARY))
    memo = tokens.IdMemo(library, np.dtype("<u2"), limit=400)
    asked = []
    words = memo._words
    memo._words = lambda led, into: asked.extend(led) or words(led, into)
    texts = ["a " + " ".join(f"{w}{end}" for w in ("süßes", "Wort", "пример", "x9", "don't", "ǆ", "é", "漢字", "\U0001e4d0", "²") for end in ("", ",", ".", "?!", "...", "'s.", "¡", ".\nB"))]
    texts += [t.replace(" ", "  ") + "  " for t in texts] + ["<|endoftext|>. a<|endoftext|>, word,<|endoftext|>."]
    for text, found in zip(texts, token_files.encode(texts, memo)):
        assert np.frombuffer(found, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and "Wort" in asked and "Wort," not in asked
    rng = random.Random(0)
    letters = "abcdefghijklmnopqrstuvwxyzäéñß"
    asked.clear()
    for _ in range(30):
        text = "first " + " ".join(["often", "again,"] + ["".join(rng.choice(letters) for _ in range(8)) for _ in range(60)])
        assert np.frombuffer(token_files.encode([text], memo)[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(memo.known) <= 400
    assert asked.count("often") == asked.count("again") == 1


def test_line_feeds_part_pieces_where_the_library_cuts():
    library = tokens.load(tokens.public_path(token_files.VOCABULARY))
    memo = tokens.IdMemo(library, np.dtype("<u2"))
    texts = ["One end.\nTwo (a)\n'sand\nÄöü, x9\n\u6f22\u5b57 b\n+1", "\nlead", "trail\n", "\n", "a<|endoftext|>\nb\n<|endoftext|>"]
    for text, found in zip(texts, token_files.encode(texts, memo)):
        assert np.frombuffer(found, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert {"end.", "\0Two", "\0\n"} <= memo.known.keys() and not any("\n" in p and p != "\0\n" for p in memo.known)
    rng = random.Random(1)
    bits = [" ", "\n", "a", "Be", "\u00fc", ",", ".", "9", "'s", "\t", "\r\n", "\x85", "\u00a0", "\x1c", "\u2028", "\u3000", "  ", "\n\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits[: rng.choice((9, len(bits)))]) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text, found in zip(texts, token_files.encode(texts, memo)):
        assert np.frombuffer(found, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_round_trip(spark, docs, odd_rows, clashing):
    path, vocabulary = fresh_path(spark, "t"), tokens.public_path(token_files.VOCABULARY)
    token_files.write(clashing, path, vocabulary)
    library = tokens.load(vocabulary)
    expected = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in odd_rows))
    start = 0
    found = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert len(found) == len(expected)
    for (has_id, doc_id, _, text), r in zip(expected, found):
        ids = library.encode(text, add_special_tokens=False).ids + [token_files.END_ID]
        assert (r.doc_id, r.start, list(r.ids)) == (doc_id if has_id else None, start, ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shuffled = [token_files.read_shuffled(spark, path, s).collect() for s in (1, 1, 2)]
    assert shuffled[0] == shuffled[1] and [r.doc_id for r in shuffled[0]] != [r.doc_id for r in shuffled[2]]
    assert Counter(tuple(r.ids) for r in shuffled[0]) == Counter(tuple(r.ids) for r in found)


def test_decontamination_leaves_clashing_columns_alone(docs, spark):
    own = docs.withColumns({"n_hit": F.lit(77), "items": F.lit("mine"), "N_Words": F.lit("x")})
    bench = spark.createDataFrame([(1, "twice the same row here")], "item_id long, text string")
    kept = decontaminate.without_hits(own, bench)
    assert kept.columns == own.columns and kept.count() == docs.count() - 2
    assert {(r.n_hit, r["items"], r.N_Words) for r in kept.collect()} == {(77, "mine", "x")}


def test_token_files_of_nothing(spark, empty):
    assert token_files.write_and_read(empty).collect() == []


def test_broken_records_are_found():
    data = bytearray(token_files.frame(5, np.array([1, 2, 3], "<u2").tobytes(), False) + b"\n")
    doc_id, ids, end = token_files.unframe(memoryview(data), 0)
    assert (doc_id, ids.tolist(), end) == (5, [1, 2, 3], len(data))
    for at in (0, 9, 14, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(memoryview(broken), 0)
    with pytest.raises(ValueError):
        token_files.unframe(memoryview(data[:-4]), 0)


# ------------------------------------------------------------ quality


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered, seen, duplicates = set(), set(), 0
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_statistics(odd_rows):
    texts = [r[1] for r in odd_rows] + odd_texts(300) + ["a b c d e a b c d e", "x\ny\nx\n\n \nx", "a | b | c # $$"]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_statistics(t)


def test_rules_find_the_bad_rows(spark, docs, empty):
    rng = np.random.default_rng(0)
    n = 600
    x = {c: rng.normal(size=n) for c in quality.FEATURES}
    bad = (x["mean_word"] > 1.0) | ((x["repeat_share"] > 0.5) & (x["upper_share"] < 0))
    rules = quality.learn(x, bad, np.arange(n) % 3 == 0)
    hit = np.zeros(n, bool)
    for rule in rules:
        hit |= quality.covers(rule, x)
    assert rules and (hit & ~bad).sum() <= 0.05 * bad.sum() and (hit & bad).sum() >= 0.85 * bad.sum()
    stats = quality.with_statistics(docs, keep=["doc_id"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn_rules(stats, none) == []
    only_good = spark.createDataFrame([(0, 1), (3, 1), (6, None), (None, 0)], "doc_id long, quality int")
    assert quality.learn_rules(stats, only_good) == []
    assert quality.with_statistics(empty).collect() == []
    kept = stats.select((~quality.base_failed() & quality.verdict(rules)).alias("kept")).collect()
    assert {r.kept for r in kept} <= {True, False}


# ------------------------------------------------------------ toxicity


def test_grammar_reads_clauses():
    readings = {"xIx": "xIx", "TxI": "Txo", "IxT": "oxT", "NxI": "Nxi", "NxxxxI": "NxxxxI", "RTxxxxxxI": "RTxxxxxxr", "HT": "dT", "TH": "Td", "IxxI": "pxxp"}
    readings |= {"IxxxxxT": "IxxxxxT", "IxIxxxT": "pxoxxxT", "NIxI": "Nixi", "HxxxxxT": "HxxxxxT", "": ""}
    assert {k: toxicity.rewrite(k) for k in readings} == readings
    # A path's weight is the sum of its arcs': the heavier reading of two wins, and a factor of 0 takes a symbol's part away.
    assert toxicity.GRAMMAR.best("IT", [1.0, 1.0]) == "oT"
    g = toxicity.Grammar({"=idiot": 5.0, "achlich+": 3.0})
    none = [0.0] * 5
    assert g.features("You idiot!")[:1] == [5.0] and g.features("an idiot of an idiot")[1] == 10.0
    assert g.features("not an idiot")[:5] == none and g.features("he said idiot")[:5] == none
    assert g.features("idiot")[:5] == none == g.features("idiotic xidiot")[:5] and g.features(None)[:5] == none
    assert g.features("idiot. achlichen")[2] == 3.0
    assert g.features("kill you. idiot")[3] == 1.0


def test_an_isolated_insult_is_below_the_threshold_and_the_grammar_counts():
    rng = random.Random(4)
    fill = lambda k: " ".join(rng.choice("re then wha tion ing ofer hand".split()) for _ in range(k))
    insults = ["scumlo", "grubby", "wormy"]
    texts, labels = [], []
    for _ in range(1200):
        kind = rng.choice(["clean", "reported", "denied", "directed", "directed"])
        words = [rng.choice(insults) for _ in range(2)]
        clauses = [f"{word} {fill(7)}" for word in ("you", "he said", "not", "you")]
        for w in words:
            made = {"clean": fill(3), "reported": f"he said {fill(2)} {w}", "denied": f"not {w}", "directed": f"you {fill(1)} {w}"}[kind]
            clauses.insert(rng.randrange(len(clauses)), f"{fill(2)} {made} {fill(2)}")
        texts.append(". ".join(clauses))
        labels.append(int(kind == "directed"))
    y = np.array(labels[800:]) == 1
    ablated, lexicon = toxicity.composed(toxicity.PILE, toxicity.WEIGHTS), {f"={w}": 2.0 for w in insults}
    right = {}
    for name, reader in (("whole", toxicity.GRAMMAR), ("ablated", ablated)):
        grammar = toxicity.Grammar(lexicon, reader)
        beta = toxicity.fit_logistic(toxicity.design([grammar.features(t) for t in texts[:800]]), np.array(labels[:800], float))
        model = toxicity.Model(lexicon, beta.tolist(), reader)
        right[name] = np.mean((model.scores(texts[800:]) >= toxicity.THRESHOLD) == y)
        if name == "whole":
            assert (model.scores([f"{fill(4)} {w} {fill(4)}" for w in insults] + insults) < toxicity.THRESHOLD).all()
    assert right["whole"] > 0.97 and right["whole"] > right["ablated"] + 0.1


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = [rng.choice("re then wha tion ing of the and".split()) + rng.choice(["er", "in", "", "ou"]) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scumlo", "grubby", "wormy" + rng.choice("abcdef")]))
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_on_held_out_rows(spark, empty):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None), (-2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(scored[i] >= toxicity.THRESHOLD) == (y == 1) for i, y in held])
    assert right > 0.95 and 0 <= scored[-1] < 0.3 and scored[-1] == scored[-2]
    marks = docs.select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in marks)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blind = toxicity.train(docs, none)
    assert {r.score for r in toxicity.with_score(docs, blind).collect()} == {0.0}
    assert toxicity.with_score(empty, model).collect() == []


# --------------------------------------------------------------- driver memory


def test_written_tables_leave_no_garbage_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHTEN_S", 0)
    trimmed = []
    trim = common._trim_native
    monkeypatch.setattr(common, "_trim_native", lambda s: (trim(s), trimmed.append(s)))
    held, weak = spark._jvm.java.util.HashSet(), spark._jvm.java.util.WeakHashMap()
    for k in range(8):
        weak.put(f"garbage {k}", k)
    held.addAll(weak.keySet())
    spark._jvm.System.gc()  # from here on only a collection of the whole heap finds them
    held.clear()
    written = common.materialize(spark.range(9), "range")
    assert weak.size() == 0 and trimmed == [spark]
    assert sorted(r.id for r in written.collect()) == list(range(9))

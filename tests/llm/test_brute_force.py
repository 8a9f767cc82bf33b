"""Queries and operators against plain versions of the same definitions, exact libraries, or held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from folioscope.llm import bag_minhash, budget_mixing, catalog, chat_windows, cross_parsing, fertility_rules, minhash_prints, near_groups, piece_codec, token_lengths  # noqa: E402
from folioscope.llm.shared import Words, mixed, shingles  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def query(spark, sf, name):
    return {r[0]: r for r in catalog.QUERIES[name](spark, sf).collect()}


def bag(text, many=True):
    w = WORD.findall(text)
    found = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    return found if many else collections.Counter(set(found))


def alike(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 1.0


def classes_of(texts, many):
    """Least id of the connected class of equal texts and of pairs at 0.8 or more, over all pairs."""
    ids = sorted(texts)
    bags = {i: bag(texts[i], many) for i in ids}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if texts[i] == texts[j] or (bags[i] and alike(bags[i], bags[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("operator, many", [(bag_minhash, True), (minhash_prints, False)])
def test_near_duplicate_classes(spark, docs, operator, many):
    # beside the table's own copies: a text with ever more words replaced, where many members are just too far from the hub
    base = [f"w{i}" for i in range(150)]
    chosen = random.Random(5)
    texts = {i: r["text"] for i, r in docs.items()}
    for n in range(60):
        words = list(base)
        for at in chosen.sample(range(150), n % 9):
            words[at] = f"new{n}_{at}"
        texts[10_000 + n] = " ".join(words)
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in operator.near_duplicates(table).collect()}
    assert got == classes_of(texts, many)
    kept = {r["doc_id"] for r in operator.deduplicated(table).collect()}
    assert kept == set(got.values())


def test_signatures_are_unbiased():
    chosen = np.random.default_rng(1)
    errors = []
    for _ in range(120):
        items = chosen.integers(0, 2**62, 200).astype(np.uint64)
        a, b = np.repeat(items, chosen.integers(1, 6, 200)), np.repeat(items[40:], chosen.integers(1, 6, 160))
        truth = near_groups.likeness(bag_minhash.multiset(a), bag_minhash.multiset(b))[0]
        errors.append((bag_minhash.signature(a) == bag_minhash.signature(b)).mean() - truth)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.07


def test_times_do_not_depend_on_the_horizon():
    seeds = np.random.default_rng(3).integers(0, 2**62, 60).astype(np.uint64)
    for block, count in ((0, 1), (2, 4)):
        found = []
        for horizon in (11.0, 14.0, 25.0):
            best = np.full(120, np.inf)
            bag_minhash._fill(best, seeds, np.full(60, count), block, horizon)
            found.append(best)
        for best in found[1:]:
            seen = np.isfinite(found[0])
            assert seen.any() and (best[seen] == found[0][seen]).all()


def test_prints(spark, sf, docs):
    got, ids, errors = query(spark, sf, "op3_minhash_prints"), sorted(docs), []
    for n, i in enumerate(ids):
        text, following = docs[i]["text"], docs[ids[(n + 1) % len(ids)]]["text"]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i]["near_edited"] - alike(bag(text, False), bag(edited, False)), got[i]["near_next"] - alike(bag(text, False), bag(following, False))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_languages_held_out(spark, sf, docs):
    got = query(spark, sf, "op4_cross_parsing")
    held = [r for r in got.values() if r["held_out"] and len(docs[r["doc_id"]]["text"]) > 40]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


@settings(max_examples=60, deadline=None)
@given(st.text("abn ", max_size=40), st.text("abn c", min_size=1, max_size=60))
def test_phrases_are_longest_matches(known, text):
    parser = cross_parsing.Parser({"x": known or "a"})
    codes = np.ones(max(map(ord, parser.symbols)) + 2, np.uint8)
    for c, i in parser.symbols.items():
        codes[ord(c)] = i
    at, count = 0, 0
    while at < len(text):
        size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in (known or "a")), 1)
        at, count = at + size, count + 1
    assert cross_parsing.phrases((parser.table, parser.roots, codes), [text])[0, 0] == count


def test_every_symbol_of_a_sample_counts():
    chosen = random.Random(4)
    known = {
        "latin": " ".join("".join(chosen.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(400)),
        "han": "".join(chr(0x4E00 + chosen.randrange(300)) for _ in range(900)), "kana": "".join(chr(0x3041 + chosen.randrange(80)) for _ in range(900))}
    parser = cross_parsing.Parser(known)
    texts = [known["han"][50:90], known["kana"][50:90] + "a", known["latin"][7:50] + "字" + known["han"][3:9], "字" + known["kana"][:700], "ж", ""]
    got = cross_parsing.phrases(parser.shipped(), texts)
    for text, counts in zip(texts, got.tolist()):
        for sample, n in zip(known.values(), counts):
            want = 0
            for block in (text[at : at + cross_parsing.BLOCK] for at in range(0, len(text), cross_parsing.BLOCK)):
                at = 0
                while at < len(block):
                    at, want = at + next((k for k in range(len(block) - at, 0, -1) if block[at : at + k] in sample), 1), want + 1
            assert n == want
    assert got[0].argmin() == 1 and got[1].argmin() == 2


def test_short_clean_documents_stay_and_noise_goes(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in table.collect()]
    like = rows[0].asDict()
    chosen = random.Random(2)
    short = [like | {"doc_id": 10_000_000 + n, "text": t} for n, t in enumerate(["A.", "De.", "a", "die", "The end."])]
    noise = ["".join(chosen.choices("qxzjkvwyhb0", k=400)), "日本語の文章です", "ж", "123", "Съешь же ещё этих мягких французских булок"]
    bad = [like | {"doc_id": 20_000_000 + n, "text": t} for n, t in enumerate(noise)]
    full = table.union(spark.createDataFrame([tuple(r[c] for c in table.columns) for r in short + bad], table.schema))
    known = table.selectExpr("doc_id key", "text", "lang").where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    kept = {r["key"] for r in cross_parsing.predicted(full.selectExpr("doc_id key", "text"), cross_parsing.train(known)).where("in_line").collect()}
    assert {r["doc_id"] for r in short} <= kept and not {r["doc_id"] for r in bad} & kept
    worded = {r["doc_id"] for r in rows if re.search(r"[^\W\d_]", r["text"] or "")}
    assert len(kept & worded) >= 0.98 * len(worded), (len(kept & worded), len(worded), [r["text"][:80] for r in rows if r["doc_id"] in worded - kept][:8])


def test_model_scores(spark, sf, docs):
    got = query(spark, sf, "op5_suffix_tree_lm")
    lower = str.maketrans({i: i + 32 for i in range(65, 91)})
    tokens = {i: WORD.findall(r["text"].translate(lower)) + ["\n"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = collections.Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        want = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(ts), sum(t in counts for t in ts), total)
        assert math.isclose(got[i]["base_score"], want, rel_tol=1e-9, abs_tol=1e-9) and got[i]["score"] < 0


def test_model_tells_held_out_texts_better_than_the_unigram(spark):
    held = [r for r in query(spark, "/root/testdata/sf0.01", "op5_suffix_tree_lm").values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_of_a_tree_sum_to_one(spark, sf):
    from folioscope.llm import suffix_tree_lm as lm

    counts = lm.counted(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    grams = counts.where(counts["kind"] == lm.WINDOW_KIND).cache()
    tree = lm.Tree(*lm.retained(grams, grams.agg({"n": "sum"}).first()[0]))
    logs = tree.logs.reshape(-1, int(tree.classes.max()) + 1).astype(float)
    unseen = lm.CODES - (int(tree.classes.max()) - 1)  # codes that share class 0; the start mark has a class but is never predicted
    totals = (10.0 ** np.delete(logs, [0, int(tree.classes[lm.START])], axis=1)).sum(axis=1) + unseen * 10.0 ** logs[:, 0]
    assert len(logs) > 100 and np.allclose(totals, 1.0, atol=1e-4)
    # the automaton ends in the longest suffix state, across block borders too
    place = {s: i for i, s in enumerate(tree.states)}
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()] + ["", "zz \u0000 unseen Ж", "A b " * 700]
    coded = [lm.symbols(t.encode()) for t in texts]
    got = lm.scores(tree.moves, tree.logs, tree.classes, coded)
    for value, c in zip(got, coded):
        raw, want = c.tobytes(), 0.0
        for at in range(lm.DEPTH, len(raw)):
            state = next(raw[at - k : at] for k in range(lm.DEPTH, -1, -1) if raw[at - k : at] in place)
            want += logs[place[state], tree.classes[raw[at]]]
        assert math.isclose(value, want, rel_tol=1e-5)


def test_joined_scores_equal_the_automaton(spark, sf, docs):
    from folioscope.llm import suffix_tree_lm as lm

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = lm.counted(table.where(table["doc_id"].isin([i for i in docs if not held[i]])).select("text"))
    grams = counts.where(counts["kind"] == lm.WINDOW_KIND).cache()
    tree = lm.Tree(*lm.retained(grams, grams.agg({"n": "sum"}).first()[0]))
    ids = sorted(docs)
    want = dict(zip(ids, lm.scores(tree.moves, tree.logs, tree.classes, [lm.symbols(docs[i]["text"].encode()) for i in ids])))
    for head in (lm.HEAD_WINDOWS, 500, 0):
        got = {r["doc_id"]: r["score"] for r in lm.model_scores(table, head_windows=head).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-4) for i in ids)


def test_contexts_of_a_small_source_stay_beside_a_large_one(spark):
    from folioscope.llm import suffix_tree_lm as lm

    small = [(int.from_bytes(f"zqxjkv{c}".encode(), "big"), 8) for c in "wy"]  # 16 occurrences
    large = [(int.from_bytes(f"abcdef{c}".encode(), "big"), 500_000_000) for c in "gh"]
    grams = spark.createDataFrame(small + large, "key bigint, n bigint")
    rows, _ = lm.retained(grams, sum(n for _, n in small + large))
    contexts = set(zip(rows.column("context").to_pylist(), rows.column("depth").to_pylist()))
    assert (ord("v"), 1) in contexts and (ord("f"), 1) in contexts


def test_conversations(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"]))
    said = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for r in rows:
        turns[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    turns[-1] = [("user", said), ("assistant", said)]
    got = query(spark, sf, "op6_chat_windows")
    assert got.keys() == turns.keys()
    for i, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(ts), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversations_are_cut_into_chunks(spark):
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], f"turn {i} " + "w " * (i % 7)) for i in range(500)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = sorted(chat_windows.windows(table, budget=40, history=12, chunk=64).collect(), key=lambda r: (r["chunk"], r["window"]))
    assert {r["chunk"] for r in made} == set(range(8))
    assert [t for r in made for t in chat_windows.read_window(r["text"], r["fresh"])] == [(r[2], r[3]) for r in rows]
    for n, r in enumerate(made):
        whole, new = chat_windows.read_window(r["text"], 0), chat_windows.read_window(r["text"], r["fresh"])
        context = whole[: len(whole) - len(new)]
        assert sum(chat_windows.tokens(*t) for t in whole) <= 40
        if n:
            assert context[0] == ("system", rows[0][3]) and 0 < sum(chat_windows.tokens(*t) for t in context[1:]) <= 12
        assert len(r["spans"]) == sum(role == "assistant" for role, _ in new)


PIECES = st.lists(st.sampled_from([*"[]<>\\/ \nans", "INST", "[INST]", "[/INST]", "<s>", "</s>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, PIECES)
def test_windows_read_back(role, text, more):
    new = [(role, text), ("assistant", more), (more, text)]
    written, fresh, spans = chat_windows.write_window([("assistant", more)], new)
    assert chat_windows.read_window(written, fresh) == new
    targets = [t for r, t in new if r == "assistant"]
    assert [chat_windows.unescape(written[a:b]) for a, b in spans] == targets


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.load(piece_codec.default_model())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return piece_codec.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the", "in", " ", "  ", "▁", "\n", "é", "日本", "😀", "\x00", "<s>", "aaaa", "www", "://", "　", ".", "1"]) | st.text(max_size=4), max_size=25).map("".join))
def test_pieces_equal_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert encoder.decode(encoder.encode(text)) == library.decode(ids)


def test_piece_digests(spark, sf, docs, library):
    for i, r in query(spark, sf, "op10_piece_codec").items():
        ids = library.encode(docs[i]["text"], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text("aeithns日é😀-", min_size=1, max_size=30))
def test_lengths_are_greedy(vocabulary, word):
    automaton = LENGTHS.setdefault("x", token_lengths.Automaton(vocabulary.ids))
    whole, at, count = "▁" + word, 0, 0
    while at < len(whole) and count >= 0:
        size = next((n for n in range(min(20, len(whole) - at), 0, -1) if whole[at : at + n] in vocabulary.ids), 0)
        at, count = (at + size, count + 1) if size else (len(whole), token_lengths.UNKNOWN)
    assert automaton.length(whole) == count


LENGTHS: dict = {}


def test_toxicity_held_out(spark, sf):
    got = query(spark, "/root/testdata/sf0.01", "op8_toxic_sentences")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_quality_counts(spark, sf, docs):
    for i, r in query(spark, sf, "op9_fertility_rules").items():
        text = docs[i]["text"]
        words, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if many[w] >= 2 for j in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_noise_is_rejected_and_prose_kept(spark, docs):
    prose = [(i, r["text"], r["lang"]) for i, r in docs.items()]
    noise = [(10_000 + n, " ".join(f"q{(n * k * 7919) % 99991:x}#$%zx{k * 31 % 17}" for k in range(1, 120)), "en") for n in range(5)]
    got = {r["doc_id"]: r for r in fertility_rules.quality(spark.createDataFrame(prose + noise, "doc_id bigint, text string, lang string")).collect()}
    assert not any(got[i]["kept"] for i, _, _ in noise)
    passed = [r for i, r in got.items() if i < 10_000 and not r["base_failed"]]
    assert sum(r["kept"] for r in passed) >= 0.9 * len(passed)


def test_word_hashes_tell_words_apart():
    words = Words()
    texts = ["a b a", "ab", "a\tb c", "x" * 3000 + " y", "é è e"]
    seen = {}
    for text in texts:
        for word, h in zip(WORD.findall(text), words.of(text).tolist()):
            assert seen.setdefault(h, word) == word
    assert len(set(seen)) == len(set(seen.values()))
    assert len(shingles(words.of("a b c"))) == 1 and len(shingles(words.of("a b c d e f"))) == 2 and len(shingles(words.of(" "))) == 0
    assert len(np.unique(mixed(np.arange(1000, dtype=np.uint64)))) == 1000


def shared_by_search(capacities, weights, budget):
    """Water level by plain search: tokens one after the other to the least filled child per weight that has room."""
    taken = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0]
    left = float(min(budget, sum(c for c, w in zip(capacities, weights) if w > 0)))
    while left > 1e-9 and open_:
        level = min(min((capacities[i] - taken[i]) / weights[i] for i in open_), left / sum(weights[i] for i in open_))
        for i in open_:
            taken[i] += level * weights[i]
        left -= level * sum(weights[i] for i in open_)
        open_ = [i for i in open_ if capacities[i] - taken[i] > 1e-9]
    return taken


def test_budgets_follow_the_water_level(spark):
    chosen = random.Random(3)
    children = [(f"p{n}", f"c{k}", chosen.randint(0, 60), chosen.randint(0, 4), chosen.randint(0, 150)) for n in range(40) for k in range(chosen.randint(1, 6))]
    budgets = {n: b for n, _, _, _, b in children}
    table = spark.createDataFrame([(n, k, c, w, budgets[n]) for n, k, c, w, _ in children], "parent string, child string, capacity bigint, weight bigint, budget bigint")
    got = collections.defaultdict(dict)
    for r in budget_mixing.shared_out(table, ["parent"], ["parent", "child"]).collect():
        got[r["parent"]][r["child"]] = r["taken"]
    for n in budgets:
        mine = [(k, c, w) for p, k, c, w, _ in children if p == n]
        want = shared_by_search([c for _, c, _ in mine], [w for _, _, w in mine], budgets[n])
        assert all(0 <= got[n][k] <= c and abs(got[n][k] - x) < 1 for (k, c, _), x in zip(mine, want))
        assert sum(got[n].values()) == min(budgets[n], sum(c for _, c, w in mine if w > 0))


def test_mixing_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cursor = db.execute(budget_mixing.SQL)
    names = [d[0] for d in cursor.description]
    got = catalog.QUERIES["op1_budget_mixing"](spark, sf).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_pipeline(spark, sf, docs, library):
    """Each stage's decisions against its operator's plain version; the whole run against the last one."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    harmless = stages["toxicity"](spark, table, sf).cache()
    spoken = stages["language"](spark, harmless, sf).cache()
    assert {r["doc_id"] for r in spoken.collect()} <= {r["doc_id"] for r in harmless.collect()} <= docs.keys()
    texts = {r["doc_id"]: r["text"] for r in spoken.collect()}
    single = stages["near duplicates"](spark, spoken, sf).cache()
    assert {r["doc_id"] for r in single.collect()} == set(classes_of(texts, True).values())
    taken = stages["mixing"](spark, single, sf).cache()
    total = sum(len(WORD.findall(r["text"])) for r in single.collect())
    used = sum(len(WORD.findall(r["text"])) for r in taken.collect())
    assert total * corpus_pipeline.SHARE // 100 <= used and {r["doc_id"] for r in taken.collect()} <= set(texts)
    want = collections.Counter((r["doc_id"], hashlib.sha256(library.decode(library.encode(r["text"])).encode()).hexdigest()) for r in taken.collect())
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()) == want

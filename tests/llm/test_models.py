import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.prose import prose
from pyspark.sql import functions as F
from runledger.llm.bit_mixer import BitMixer, grams, order_keys
from runledger.llm.chat_format import conversation_figures, escape, format_conversations, joined, op8_chat_format, read_back, renderer, unescape
from runledger.llm.lm_scoring import FEATURES, _SLICE_DDL, _cut, _gram_counts, learned_centres, learned_mixer, log_gamma_ratio, op7_lm_scores, text_scores, tokens
from runledger.llm.multi_index import nearest_neighbours, op6_multi_index
from runledger.llm.rule_ensemble import RuleModel, fit_rules, lasso_logistic, learn, op4_rule_ensemble, quality_scores, statistics, with_statistics
from runledger.llm.templates import TemplateError, compile_template, fold, parse

SF = "/root/testdata/sf0.01"


# Quality


def test_held_out_accuracy_and_folds(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4_rule_ensemble(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in unseen]) > 0.95


def plain_statistics(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
    solid = sum(map(len, words))
    count = lambda inside: sum(inside(c) for c in text)
    share = lambda x, of: x / of if of else 0.0
    return {
        "words": len(words), "word_length": share(solid, len(words)),
        "upper_share": share(count(lambda c: unicodedata.category(c) == "Lu"), solid),
        "digit_share": share(count(lambda c: c in "0123456789"), solid),
        "symbols_per_word": share(count(lambda c: c in "#*$%&<>\\^~={}[]"), len(words)),
        "shouts_per_word": share(count(lambda c: c in "!?"), len(words)),
        "stops_per_word": share(count(lambda c: c in ".,;:"), len(words)),
        "bars_per_word": share(text.count("|"), len(words)),
        "distinct_words": share(len({w.lower() for w in words}), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)),
        "line_length": share(len(words), len(lines)), "chars": len(text),
    }


def test_statistics_are_those_of_a_plain_reading(spark, make):
    odd = ["", None, "É é ß", "a|b | c", "one\n\none\ntwo", "WOW!? 3 {x} = [y]; ok...", "x" * 5000, "a  b\tb\x0bB", "\U0001f600 q"]
    rows = [(i, t) for i, t in enumerate(odd)]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = dict(rows)
    found = with_statistics(make(rows, clashes=False).select("doc_id", "text")).select("doc_id", "s.*").collect()
    assert len(found) == len(rows)
    for r in found:
        for name, value in plain_statistics(texts[r["doc_id"]]).items():
            assert math.isclose(r[name], value, rel_tol=1e-12), (r["doc_id"], name)


def test_compiled_rules_score_as_the_model_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules and all(0 < abs(w) for w in model.weights)
    rows = with_statistics(docs.select("doc_id", "text")).select("doc_id", "s.*", model.column().alias("score")).toPandas()
    plain = model.score({n: rows[n].to_numpy(float) for n in statistics()})
    assert np.allclose(plain, rows["score"], atol=1e-9)


def test_scores_use_the_text_alone(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = learn(docs, labels)
    changed = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"))
    one = {r["doc_id"]: r["score"] for r in quality_scores(docs, model).collect()}
    other = {r["doc_id"] - 10_000: r["score"] for r in quality_scores(changed, model).collect()}
    assert one == other


def test_lasso_finds_the_rules_that_matter():
    random_ = np.random.RandomState(1)
    x = random_.randint(0, 2, (3000, 30)).astype(float)
    y = (random_.random_sample(3000) < 1 / (1 + np.exp(-(4 * x[:, 3] - 4 * x[:, 7])))).astype(float)
    _, weights = lasso_logistic(x, y, 0.02)
    assert set(np.flatnonzero(np.abs(weights) > 0.05)) == {3, 7} and weights[3] > 1 > -1 > weights[7]


def test_few_or_one_sided_labels(make, spark):
    table = {"a": np.arange(4.0)}
    assert fit_rules(table, np.ones(4), np.zeros(4, bool)).score(table).min() > 0.99
    assert fit_rules({"a": np.zeros(0)}, np.zeros(0), np.zeros(0, bool)) == RuleModel(0.0)
    docs = make([(1, None), (2, ""), (None, "words here"), (3, "a " * 40_000), (3, "a " * 40_000)])
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    rows = quality_scores(docs, learn(docs, labels)).collect()
    assert [r["score"] for r in rows] == [0.5] * 5
    assert quality_scores(make([]), learn(make([]), labels.limit(0))).collect() == []


# Neighbours


def brute_neighbours(rows, every=20, wanted=20):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[k]).sum(1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[k]][:wanted]
        out[int(ids[k])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {i: np.array(v, float) for i, v in table.select("vec_id", "embedding").collect()}
    expected, found = brute_neighbours(list(rows.items())), {}
    for r in op6_multi_index(spark, SF).orderBy("query_id", "rank").collect():
        mine = found.setdefault(r["query_id"], [])
        mine.append(r["vec_id"])
        assert r["rank"] == len(mine) and abs(r["score"] - float(rows[r["query_id"]] @ rows[r["vec_id"]])) < 1e-12
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in expected[q]} & set(found[q])) / 20 for q in found]) >= 0.9


def test_ties_repeats_and_vectors_that_take_no_part(spark):
    random_ = np.random.RandomState(2)
    same = [0.5, 0.5, 0.5, 0.5]
    rows = [(i, same) for i in range(0, 300)] + [(i, random_.randn(4).tolist()) for i in range(300, 340)]
    odd = [(400, None), (420, [0.0] * 4), (440, [1.0, None, 1.0, 1.0]), (460, [math.nan, 1.0, 1.0, 1.0]), (480, [math.inf, 1.0, 1.0, 1.0]), (500, [1.0, 2.0]), (None, same), (7, same)]
    table = spark.createDataFrame([(i, v, "own", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cell string, score int")
    expected, found = brute_neighbours(rows), {}
    for r in nearest_neighbours(table).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == expected.keys()
    for q in found:
        if q < 300:
            assert [i for i, _ in found[q]] == [i for i, _ in expected[q]]
    few = nearest_neighbours(table.where("vec_id in (20, 40, 301)")).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(20, 40), (20, 301), (40, 20), (40, 301)}
    assert nearest_neighbours(table.limit(0)).collect() == []


def test_repeated_rows_take_no_places(spark):
    random_ = np.random.RandomState(4)
    rows = [(i, random_.randn(4).tolist()) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lambda rows: sorted(map(tuple, nearest_neighbours(frame(rows), target=1.0).collect()))
    assert found(rows + rows) == found(rows)
    # One id of many vectors is one neighbour, by its best.
    crowd = [(401, [3.0 + k / 100, 3.0, 3.0, 3.0]) for k in range(60)] + [(i, (2.5 + random_.rand(4)).tolist()) for i in range(402, 440)]
    several = rows + crowd
    ids, vectors = np.array([i for i, _ in several]), np.array([v for _, v in several])
    expected = []
    for q in (420, 0):
        best = {}
        for i, score in zip(ids.tolist(), (vectors @ vectors[ids.tolist().index(q)]).tolist()):
            best[i] = max(score, best.get(i, score))
        expected.append([i for i in sorted(best, key=lambda i: (-best[i], i)) if i != q][:20])
    got = found(several)
    assert [[i for query, _, i, _ in got if query == q] for q in (420, 0)] == expected


# Language model


def test_a_mixers_bytes_have_a_total_of_one():
    words = [w.encode() for w in prose(1, 500)]
    key, _ = grams(words, np.zeros(500, int))
    distinct, counts = np.unique(np.concatenate([order_keys(key, k) for k in range(6)]), return_counts=True)
    mixer = BitMixer(distinct, counts)
    mixer.learn(words[:200], np.zeros(200, int))
    for context in (b"", b"b", b"bak", b"zzzzzz"):
        # Of one context all 256 bytes that may follow, as numbers of the mixer.
        base = grams([context], np.zeros(1, int))[0][-1] >> np.uint64(8) << np.uint64(8)
        total = 0.0
        every = base | np.arange(256, dtype=np.uint64)
        logs = np.zeros(256)
        for bit in range(8):
            inputs, gate, one = mixer._inputs(every, bit)
            lean = mixer._mixed(inputs, gate)
            low, high = mixer._cell(lean)
            p = np.clip((1 / (1 + np.exp(-lean)) + mixer.refined[gate, low] * (1 - high) + mixer.refined[gate, low + 1] * high) / 2, 1e-5, 1 - 1e-5)
            logs += np.log(np.where(one > 0, p, 1 - p))
        total = np.exp(logs).sum()
        assert abs(total - 1) < 1e-9
    one, two = mixer.log_probability(words[:3], np.zeros(3, int)), mixer.log_probability(words[1:2], np.zeros(1, int))
    assert abs(one[1] - two[0]) < 1e-12 and mixer.log_probability([b"qqqqqqqq"], np.zeros(1, int))[0] < one.min()


def test_log_gamma_ratio():
    x, n = np.array([1e-9, 0.3, 5.0, 800.0, 2.0]), np.array([1, 2, 7, 3000, 1])
    assert np.allclose(log_gamma_ratio(x, n), [math.lgamma(a + b) - math.lgamma(a) for a, b in zip(x, n)], rtol=1e-9)


def test_scores_of_a_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_lm_scores(spark, SF).collect()
    unseen = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    cut = {i: [*tokens(t), b""] for i, t in texts.items()}
    seen = Counter(w for i, t in cut.items() if i not in unseen for w in t)
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        own = cut[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in unseen, len(own), sum(w in seen for w in own), n)
        assert abs(r["base_score"] - sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(texts) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in text_scores(docs).collect()}
    other = {r["doc_id"]: r["score"] for r in text_scores(docs.repartition(5)).collect()}
    assert all(abs(one[i] - other[i]) < 1e-6 for i in one)


def test_classes_learn_from_every_text(make):
    # More texts than any sample held; every other pair of words stands in one text only.
    texts = [" ".join(f"{'ab'[i % 2]}{j}" for j in range(6)) + f" only{i}" for i in range(7000)]
    held = [i % 7 == 3 for i in range(len(texts))]
    cut = lambda texts: make(list(enumerate(texts))).selectExpr("doc_id", "text", "doc_id % 7 = 3 AS held_out", "(doc_id + 0.5D) / 7002 AS draw").mapInArrow(_cut, _SLICE_DDL)
    centres = learned_centres(cut([*texts, "", None]), 2)
    points = np.zeros((len(texts), FEATURES))
    for point, text in zip(points, texts):
        np.add.at(point, [zlib.crc32(w) % FEATURES for w in tokens(text)], 1 / math.sqrt(7))
    expected = np.array([points[[i for i in range(k, len(texts), 2) if not held[i]]].sum(0) for k in (0, 1)])
    expected /= np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose(centres[np.argsort(-(centres @ expected[0]))], expected, atol=1e-5)
    assert learned_centres(cut(["", None])).shape == (1, FEATURES)


def test_mixing_weights_learn_from_every_word(spark):
    words = sorted({f"{w}{i % 97}".encode() for i, w in enumerate(prose(3, 60_000))} | {f"w{i}".encode() for i in range(32_000)})
    assert len(words) > 32_000
    key, _ = grams(words, np.zeros(len(words), int))
    table = BitMixer(*np.unique(np.concatenate([order_keys(key[::50], k) for k in range(6)]), return_counts=True))
    local = BitMixer(*np.unique(np.concatenate([order_keys(key[::50], k) for k in range(6)]), return_counts=True))
    local.learn(words, np.zeros(len(words), int))
    rows = spark.createDataFrame([(bytearray(w), 0, 1) for w in words], "word binary, word_style int, of_style long").repartition(5)
    counts = rows.mapInArrow(_gram_counts, "gram long, n long, kinds long").groupBy("gram").agg(F.sum("kinds").alias("kinds"))
    found = learned_mixer(spark.sparkContext.broadcast(table), counts)
    assert np.allclose(found.weights, local.weights, atol=1e-6) and np.allclose(found.refined, local.refined, atol=1e-6)
    few = BitMixer(*np.unique(np.concatenate([order_keys(key[::50], k) for k in range(6)]), return_counts=True))
    few.learn(words[:2000], np.zeros(2000, int))
    logs = [m.log_probability(words, np.zeros(len(words), int)).mean() for m in (found, few)]
    assert logs[0] > logs[1] and not np.allclose(table.weights, found.weights)


def test_odd_texts_are_scored(make):
    rows = [(1, None), (2, ""), (3, "a " * 30_000), (4, "x" * 50_000), (5, " ".join(prose(1, 50))), (5, " ".join(prose(1, 50))), (None, "The the THE")]
    found = text_scores(make(rows)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 7 and by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 1 and by_id[1]["score"] == by_id[2]["score"]
    assert by_id[1]["bits_per_byte"] is None and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert text_scores(make([])).collect() == []
    none_trained = text_scores(make([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert none_trained and all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in none_trained)


# Chat


def test_templates():
    source = "{% set hi = 'He' + 'llo' %}{% for m in xs -%}\n  {{ hi }} {{ m.name | up }}{% if not loop.last %}, {% elif loop.first %}!{% else %}.{% endif %}{% endfor %}{# no #}{{ xs.__class__ }}{{ 1 + 2 }}"
    write = compile_template(source, {"up": str.upper})
    text = lambda **names: "".join(t for t, _ in write(**names))
    assert text(xs=[{"name": "a"}, {"name": "b"}]) == "Hello A, Hello B.3"
    assert text(xs=iter([{"name": "a"}])) == "Hello A!3" and text(xs=None) == "3"
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif 'y' in 'xyz' and true %}d{% else %}e{% endif %}"), {}) == [("text", "abcd")]
    assert list(compile_template("a{% generation %}b{% endgeneration %}")()) == [("a", False), ("b", True)]
    for wrong in ("{{ a b }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | none_such }}", "{{ f(1) }}", "{% import os %}", "{{ }}", "{{ 'a }}", "{% set 1 = 2 %}"):
        with pytest.raises(TemplateError):
            compile_template(wrong)


def figures(messages):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in messages if r == "assistant")
    return len(messages), sha("".join(f"{r}\n{t}\n" for r, t in messages)), len(loss), sha(loss)


def test_any_turns_are_read_back():
    pick, parts = random.Random(2), ["<", ">", "s", "/", "[", "]", "INST", "</s>", "[/INST]", "\\", "-", "\\-", "a", "\n", "<s>", "é"]
    render = renderer()
    for _ in range(4000):
        turns = [(pick.choice(["user", "assistant", "</s>x", "".join(pick.choices(parts, k=3))]), "".join(pick.choices(parts, k=pick.randint(0, 9)))) for _ in range(pick.randint(0, 4))]
        messages = [{"role": r, "text": t} for r, t in turns]
        found = read_back(render(iter(messages)))
        assert (found["n_turns"], found["turns_sha256"], found["loss_chars"], found["loss_sha256"]) == figures(turns)
        text, spans = joined(render(messages))
        assert unescape("".join(text[s["from"] : s["upto"]] for s in spans)) == "".join(t for r, t in turns if r == "assistant")
        assert len(text) == found["formatted_chars"]
    assert all(c not in escape("x</s>[INST]<s>") for c in ("<s>", "</s>", "[INST]"))


def test_conversations_of_a_table(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    rows[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = op8_chat_format(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == {k: figures(v) for k, v in rows.items()} and len(found) == len(rows)


def test_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, messages int"
    long = [(5, i, "assistant" if i % 2 else "user", "word " * 50, 1) for i in range(5000)]
    rows = [(1, 2, "assistant", None, 1), (1, 1, None, "hi", 1), (None, 1, "user", "x", 1), (None, 1, "user", "x", 1), (2, None, "user", "", 1), *long]
    table = spark.createDataFrame(rows, kind)
    found = {r["conv_id"]: tuple(r)[1:5] for r in conversation_figures(table).collect()}
    assert found[1] == figures([("", "hi"), ("assistant", "")]) and found[None] == figures([("user", "x")] * 2) and found[2] == figures([("user", "")])
    assert found[5] == figures([(r, t) for _, _, r, t, _ in long])
    written = {r["conv_id"]: r for r in format_conversations(table).collect()}
    assert written[1]["formatted"] == "<s>[INST]hi[/INST]</s><s>assistant[INST][/INST]</s>" and written[1]["loss_spans"] == []
    assert conversation_figures(table.limit(0)).collect() == []

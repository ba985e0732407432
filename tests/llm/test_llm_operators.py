"""The text-preparation operators against brute force, and on nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import chat, decontam, fingerprints, languages, licenses, mixing, near_dup, sharding, toxicity, urls
from lorekeep.llm import text as T
from lorekeep.session import saved, table

LONG = "heron " * 60_000
EDGES = [
    (1, "A plain text about herons and mills by the river, five words and more.", "en", "s0", 5, "x", 1),
    (1, "A plain text about herons and mills by the river, five words and more.", "en", "s0", 5, "x", 1),
    (2, "a plain TEXT about herons and mills by the river five words and more", None, None, None, None, None),
    (3, None, "fr", "s1", 0, "y", 2),
    (4, "", "de", "s1", 0, "y", 2),
    (5, "!!! ???", "de", "s1", 0, "y", 2),
    (6, LONG, "en", "s2", 0, "y", 2),
    (7, "one", "en", "s2", 0, "y", 2),
    (8, "All rights\nreserved. all RIGHTS reserved; licensed under CC BY", "en", "s2", 0, "y", 2),
    (None, "No id here but words enough to make a shingle of five", "en", "s2", 0, "y", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SMALL, "labels")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_words_by_bytes():
    import numpy as np

    texts = ["", "A b,c", "é-É x1_y", "\ud7ff日本 語", "..."]
    raw = [t.encode() for t in texts]
    words = T.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    got = [[bytes(words.bytes[s:e]) for s, e, t in zip(words.start, words.end, words.text) if t == i] for i in range(len(texts))]
    assert got == [T.words_of(t) for t in texts]


def test_license_places(spark, docs, edges):
    for rows in (docs, edges):
        got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op1_license_scan(rows).collect())
        want = []
        for r in rows.collect():
            words, places, names = T.words_of(r.text), [], set()
            for phrase, label in licenses.PHRASES.items():
                own = phrase.encode().split()
                for i in range(len(words) - len(own) + 1):
                    if words[i : i + len(own)] == own:
                        places.append(i)
                        names.add(label)
            want.append((r.doc_id or -1, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))))
        assert got == sorted(want, key=repr) or sorted(got, key=repr) == sorted(want, key=repr)


def test_license_scan_of_an_empty_table(no_docs):
    assert licenses.op1_license_scan(no_docs).count() == 0


def test_license_containment(spark):
    template = {"alpha beta gamma delta epsilon zeta eta theta iota kappa": "ten"}
    words = list(template)[0].split()
    rows = [(0, " ".join(words)), (1, " ".join(words[:9]) + " x"), (2, " ".join(words[:8])), (3, "x " * 100 + " y ".join(reversed(words)) + " z" * 90)]
    got = {r.doc_id: bool(r.hits) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), template, {}).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def shingle_sets(texts):
    out = {}
    for i, text in texts.items():
        w = T.words_of(text)
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def brute_classes(texts):
    sets, parent = shingle_sets(texts), {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def near_copies(n=60, seed=5):
    """A base, copies with up to four changed words, copies of copies, and others."""
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    made = [base]
    for _ in range(n):
        words = list(rng.choice(made))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        made.append(words)
    made += [[rng.choice(vocabulary) for _ in range(80)] for _ in range(10)]
    return {i: " ".join(w) for i, w in enumerate(made)}


def test_near_duplicates_equal_brute_force(spark, docs):
    for texts in (texts_of(docs), near_copies(), near_copies(120, 6)):
        rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.class_id for r in near_dup.op2_near_dedup(rows).collect()}
        assert got == brute_classes(texts)


def test_near_duplicates_with_repeated_lines(spark):
    """Equal sets of shingles, a third of them repeated 2 times in one text and 300 times in the other: one class each."""
    rng, texts = random.Random(9), {}
    for k in range(30):
        line, rest = " ".join(f"l{rng.random()}" for _ in range(30)), " ".join(f"r{rng.random()}" for _ in range(70))
        texts[2 * k], texts[2 * k + 1] = f"{line} {line} {rest}", " ".join([line] * 300 + [rest])
    got = {r.doc_id: r.class_id for r in near_dup.op2_near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in texts}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "key": [str(i) for i in texts], "text": list(texts.values())})
    bands = [b for out in near_dup._sketch([batch]) for b in out.column(3).to_pylist()]
    assert all(bands[i] == bands[i - i % 2] for i in texts)  # so each pair meets in every band


def test_near_duplicates_of_edges(edges, no_docs):
    got = [(r.doc_id, r.class_id) for r in near_dup.op2_near_dedup(edges).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8), (None, None)], key=repr)
    kept = near_dup.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 5, 6, 7, 8, None], key=repr)
    assert near_dup.op2_near_dedup(no_docs).count() == 0


def test_probability_jaccard_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = dict(zip(values[:200], rng.integers(1, 4, 200))), dict(zip(values[50:250], rng.integers(1, 4, 200)))
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in set(a) | set(b)) for x in set(a) & set(b))
    text = np.repeat([0, 1], [len(a), len(b)])
    out = near_dup.probminhash(text, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()], float), 2, 4000)
    assert abs((out[0] == out[1]).mean() - exact) < 0.04


def test_rates_meet_targets_or_come_closest(spark):
    """Against projected gradient over the rates themselves, one number a document, on reachable and unreachable targets."""
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.5, 0.4], 150) * 0.85 + 0.05  # no document is wholly of one domain
    tokens = rng.integers(0, 60, 150)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    n = tokens.sum()
    for targets in ([0.5, 0.3, 0.2], [0.2, 0.2, 0.6], [0.98, 0.01, 0.01], [0.0, 0.0, 1.0]):
        rated, found = mixing.rates(members, targets)
        rate = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
        assert found.settled and rate.min() >= 0 and rate.max() <= mixing.MOST
        reached = (tokens * rate) @ p / n
        assert np.allclose(reached, found.reached, atol=1e-9)
        r, step = np.ones(150), 1 / np.linalg.norm(np.sqrt(tokens / n)[:, None] * p, 2) ** 2
        for _ in range(20_000):
            r = np.clip(r - step * p @ ((tokens * r) @ p / n - targets), 0, mixing.MOST)
        least = np.linalg.norm((tokens * r) @ p / n - targets)
        assert np.linalg.norm(reached - targets) <= least + 1e-3


def test_rates_come_closest_where_few_can_move(spark):
    """Posteriors near the corners and unreachable targets: most rates rest at a bound, so that steps are long."""
    import numpy as np

    corners = np.array([[0.96, 0.025, 0.015], [0.3, 0.68, 0.02], [0.2, 0.1, 0.7]])
    for seed, targets in ((0, [0.9, 0.1, 0.0]), (1, [0.6, 0.4, 0.0]), (2, [1.0, 0.0, 0.0])):
        rng = np.random.default_rng(seed)
        p = np.array([rng.dirichlet(corners[c] * 100) for c in rng.choice(3, 150, p=[0.7, 0.25, 0.05])]) * 0.97 + 0.01
        tokens = rng.integers(0, 60, 150)
        members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
        _, found = mixing.rates(members, targets)
        r, n, step = np.ones(150), tokens.sum(), 1 / np.linalg.norm(np.sqrt(tokens / tokens.sum())[:, None] * p, 2) ** 2
        for _ in range(20_000):
            r = np.clip(r - step * p @ ((tokens * r) @ p / n - targets), 0, mixing.MOST)
        assert np.linalg.norm(np.array(found.reached) - targets) <= np.linalg.norm((tokens * r) @ p / n - targets) + 1e-3


def test_mixing(spark, docs, labels, edges, no_docs):
    big, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = mixing.op3_mixing(big, marks)
    first = out.first()
    for domain, target in mixing.TARGETS.items():
        assert abs(first[f"reached_{domain}"] - target) <= 0.01 * target
    assert out.count() == big.count()
    known = {r.doc_id: (r.quality, r.toxic) for r in marks.collect()}
    likely = [(max(("good", "low", "toxic"), key=lambda d: r[f"p_{d}"]), known[r.doc_id]) for r in out.collect() if r.doc_id in known]
    assert sum(d == ("toxic" if t else "good" if q else "low") for d, (q, t) in likely) >= 0.8 * len(likely)
    out = mixing.op3_mixing(edges, labels)
    assert out.count() == len(EDGES) and out.where("rate < 0 or isnan(rate)").count() == 0
    assert mixing.op3_mixing(no_docs, labels).count() == 0
    mixed = mixing.mixed(docs, labels, {"good": 0.9, "low": 0.1}, "good")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & set(texts_of(docs))
    assert mixed.columns == docs.columns and len(good & {r.doc_id for r in mixed.collect()}) >= 0.8 * len(good)
    odd = docs.withColumn("p", docs.lang).withColumn("tokens", docs.lang).withColumn("times", docs.lang).withColumn("row", docs.lang)
    mixed = mixing.mixed(odd, labels, {"good": 0.9, "low": 0.1}, "good")
    assert mixed.columns == odd.columns and mixed.where("p <> lang or tokens <> lang or times <> lang or row <> lang").count() == 0


def test_languages_of_held_out(docs, edges, no_docs):
    got = languages.op4_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.93 * len(got)
    out = {r.doc_id: r.lang_pred for r in languages.op4_language(edges).collect()}
    assert out[3] == out[4] == out[5] == "und" and languages.op4_language(edges).count() == len(EDGES)
    assert languages.op4_language(no_docs).count() == 0


def test_language_of_the_nearest_centroid(spark):
    """Predictions against cosines by hand; two languages with the same texts tie, and the first by name wins."""
    import numpy as np

    rng = random.Random(12)
    kinds = {"aa": "bcdf", "bb": "xyzw", "cc": "bcdf"}
    pool = [" ".join("".join(rng.choice(kinds["aa"]) for _ in range(4)) for _ in range(20)) for _ in range(40)]
    rows = [(3 * i + k, pool[i] if lang != "bb" else " ".join("".join(rng.choice("xyzw") for _ in range(4)) for _ in range(20)), lang) for i in range(40) for k, lang in enumerate(kinds)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["bcd fbc", "xyz", "", "123", None, "é"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs)
    got = {r.doc_id: r for r in languages.predict(docs, model).collect()}
    for i, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        grams = f" {text.lower()} ".encode()
        counts = np.zeros(languages.DIMS)
        for k in range(len(grams) - 2):
            gram = grams[k] << 16 | grams[k + 1] << 8 | grams[k + 2]
            counts[(gram * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        near = model.centres @ (v / max(np.linalg.norm(v), 1e-12))
        assert got[i].lang_pred == model.langs[int(np.argmax(near))] and abs(got[i].score - min(max(near.max(), 0), 1)) < 1e-9
    assert {got[3 * i + k].lang_pred for i in range(40) for k in (0, 2)} <= {"aa", "cc"} and all(got[3 * i + 1].lang_pred == "bb" for i in range(40))


@given(st.text(), st.text())
@settings(max_examples=5, deadline=None)
def test_chat_escape_is_reversible(spark, text, role):
    tricky = text + "<|im_end|>" + role + "\\<\\|\n"
    tricky = tricky.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
    rows = [(1, 0, tricky, tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", None), (1, 3, None, tricky)]
    chats = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.read_back(chats).first()
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert list(got.learnt) == [tricky, ""]
    escaped = tricky.replace("\\", "\\\\").replace("<|", "<\\|")
    whole = got.text
    assert [whole[s.start : s.start + s.chars] for s in got.loss] == [escaped, ""]


def test_chat_equals_oracle(spark):
    import compare

    assert compare.differences(spark, {"q": lambda s, d: chat.op5_chat(table(s, d, "conversations"))}, {"q": chat.ORACLE}, "q", SMALL) == ""


def test_chat_of_odd_tables(spark):
    """Empty tables, repeated rows, null ids and turns, equal turns, clashing names."""
    rows = [(None, 1, "user", "a", "x"), (None, None, "user", "b", "x"), (2, 1, "assistant", "c", "x"), (2, 1, "assistant", "c", "x"), (2, 1, "assistant", None, "x"), (2, 0, "user", "d", "x"), (2, 3, "user", "", "x")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(given)).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "b"), ("user", "a")] and got[None].n_blocks == 1
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "d"), ("assistant", ""), ("assistant", "c"), ("assistant", "c"), ("user", "")]
    assert (got[2].n_turns, got[2].n_blocks, list(got[2].learnt)) == (5, 3, ["", "c", "c"])
    assert [r.conv_id for r in chat.op5_chat(given.limit(0)).collect()] == [-1]
    many = [(7, i, "assistant" if i % 3 else "user", f"text {i}") for i in range(3000)]
    r = chat.read_back(chat.formatted(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in many]
    assert list(r.learnt) == [text for _, _, role, text in many if role == "assistant"] and r.n_blocks == 2000


URLS = [
    (1, "http://Example.COM/en/7?x", "example.com", "/en/7", "example.com/en/7", "allow"),
    (2, "https://a.b.com/en/9#t", "a.b.com", "/en/9", "com/en/", "block"),
    (3, "https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (4, "ftp://net/de/", "net", "/de/", "net/de/", "allow"),
    (5, "x://s.example.net/de/81", "s.example.net", "/de/81", "example.net/de/8", "block"),
    (6, "//a.org/es/1", "", "", None, None),
    (7, None, "", "", None, None),
    (8, "http://a.org?x=://b.org/es/", "a.org", "", None, None),
]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "<p>words</p>", "clash") for i, u, *_ in URLS], "page_id long, url string, html string, score string")
    got = {r.page_id: r for r in urls.op6_url_filter(rows).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.op6_url_filter(rows.limit(0)).count() == 0


def test_url_rules_that_tie(spark):
    """Of equally long rules that fit, the first by name; repeated rows are each judged, null pages too."""
    rows = [(1, "http://a.b.com/en/", None, "x"), (1, "http://a.b.com/en/", None, "x"), (2, None, None, "x"), (None, "http://b.com/en/", "<p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, words string")
    got = urls.op6_url_filter(pages, {"b.com/en": "allow", "b.com/e": "block", "com/en/": "block", "b.com/en/": "block", "a.b.com/": "allow"}).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got if r.rule) == [(0, "b.com/en/", "block"), (1, "b.com/en/", "block"), (1, "b.com/en/", "block")]
    tie = urls.op6_url_filter(pages, {"com/en/": "block", "b.com/e": "allow"}).collect()
    assert {r.rule for r in tie if r.page_id == 1} == {"b.com/e"} and len(tie) == 4


def test_url_words():
    split = urls.Segmenter({"online": 50, "casino": 20, "line": 30, "on": 200, "cas": 1})
    assert split.split("onlinecasino") == ["online", "casino"] and split.split("") == []


def test_url_words_of_a_large_vocabulary(spark):
    """Rare words count too: of more than 50,000 words, hosts made of those seen once are still split into them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["q" + "".join(letters[k // 26**i % 26] for i in range(4)) + "x" for k in range(60_000)]
    rows = [(i, f"http://{rare[i]}{rare[i + 1]}.org/", " ".join(rare[i * 600 : (i + 1) * 600])) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    host, path = urls.host_and_path("url")
    got = {r.host: list(r.words) for r in urls.host_words(pages.select(host.alias("host"), path.alias("path")), urls.word_counts(pages)).collect()}
    assert len(got) == 100 and all(got[f"{rare[i]}{rare[i + 1]}.org"][:2] == rare[i : i + 2] for i in range(100))


def test_url_scores_equal_brute_force(spark):
    """Multinomial naive Bayes by hand over the same words; pages whose content tells teach it, also for others' urls."""
    import math

    bad = "<p>casino news: casino, casino and bets</p><script>casino casino casino</script>"
    rows = [(i, f"http://{'junk' if i % 4 == 0 else 'mill'}corner.org/{'offer' if i % 4 == 0 else 'news'}/{i}", bad if i % 8 == 0 else "<p>mill corner junk river</p><script>casino casino casino</script>") for i in range(64)]
    rows += [(100, None, None), (101, "http://junkcorner.org/offer/1", "<p>mill</p>"), (101, "http://junkcorner.org/offer/1", "<p>mill</p>"), (102, "http://poker.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.op6_url_filter(pages, {}).collect()

    def words(url):
        if not url:
            return []
        host, _, path = url.split("://")[1].partition("/")
        split = {"junkcorner.org": ["junk", "corner"], "millcorner.org": ["mill", "corner"], "poker.org": ["poker"]}[host]
        return [*split, "org"] + ["/" + ("0" if w.isdigit() else w) for w in path.split("/") if w]

    counts, pages_of = ({}, {}), [0, 0]
    for _, url, html in rows:
        own = words(url)
        label = int(html == bad or "poker" in own)
        pages_of[label] += 1
        for w in own:
            counts[label][w] = counts[label].get(w, 0) + 1
    split = {tuple(r.words) for r in urls.host_words(pages.select(urls.host_and_path("url")[0].alias("host")), urls.word_counts(pages)).collect()}
    assert split == {("junk", "corner", "org"), ("mill", "corner", "org"), ("poker", "org"), ()}
    every = set(counts[0]) | set(counts[1])
    sums = [sum(c.get(w, 0) + 0.1 for w in every) for c in counts]
    for r in got:
        url = next(u for i, u, _ in rows if i == r.page_id)
        want = math.log((pages_of[1] + 0.5) / (pages_of[0] + 0.5)) + sum(math.log((counts[1].get(w, 0) + 0.1) / sums[1]) - math.log((counts[0].get(w, 0) + 0.1) / sums[0]) for w in words(url))
        assert abs(r.score - want) < 1e-6
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[101] == "block" and verdicts[4] == "block" and verdicts[1] == "allow" and verdicts[100] == "allow" and len(got) == len(rows)


def brute_fingerprint(hashes, window):
    n = max(1, len(hashes) - window + 1)
    out = []
    for i in range(n if hashes else 0):
        part = hashes[i : i + window]
        least = min(part)
        at = i + max(k for k, h in enumerate(part) if h == least)
        if at not in out:
            out.append(at)
    return out


def test_winnowing_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(n))) for i, n in enumerate([*range(0, 30), 60, *range(100, 132), 200, 700])]
    held = fingerprints.with_fingerprint(spark.createDataFrame(texts, "doc_id long, text string"), "text", "f")
    held = held.select("text", fingerprints.positions("f").alias("p"), fingerprints.hashes("f").alias("h")).collect()
    known = {}  # equal grams have equal hashes, wherever they stand
    for r in held:
        for p, h in zip(r.p, r.h):
            assert known.setdefault(r.text[p : p + fingerprints.GRAM] if len(r.text) >= fingerprints.GRAM else r.text, h) == h
    grams = {g: None for r in held for g in (r.text[i : i + fingerprints.GRAM] for i in range(max(1, len(r.text) - fingerprints.GRAM + 1))) if g}
    alone = fingerprints.with_fingerprint(spark.createDataFrame([(g,) for g in grams], "text string"), "text", "f").select("text", fingerprints.hashes("f").alias("h"))
    grams = {r.text: r.h[0] for r in alone.collect()}
    for r in held:
        hashes = [grams[r.text[i : i + fingerprints.GRAM]] for i in range(max(1, len(r.text) - fingerprints.GRAM + 1))] if r.text else []
        assert list(r.p) == brute_fingerprint(hashes, fingerprints.WINDOW) and [hashes[p] for p in r.p] == list(r.h)


def test_match_guarantee(spark):
    """Any shared run of GRAM + WINDOW - 1 code points gives a shared hash, at places as far apart as the runs."""
    rng, need = random.Random(8), fingerprints.GRAM + fingerprints.WINDOW - 1
    rows, at = [], {}
    for i in range(40):
        shared = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(need))
        a, b = ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(90))) for _ in range(2))
        rows += [(2 * i, a + shared + b), (2 * i + 1, b + shared + a)]
        at[2 * i], at[2 * i + 1] = len(a), len(b)
    held = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "f")
    got = {r.doc_id: dict(zip(r.h, r.p)) for r in held.select("doc_id", fingerprints.positions("f").alias("p"), fingerprints.hashes("f").alias("h")).collect()}
    for i in range(40):
        x, y = got[2 * i], got[2 * i + 1]
        assert any(x[h] - at[2 * i] == y[h] - at[2 * i + 1] >= 0 for h in set(x) & set(y))


def test_edited_texts(spark, docs, edges):
    """Every column against brute force: texts, fingerprints, positions and likenesses; no Python runs in the plan."""

    def likeness(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    rng = random.Random(5)
    # halves around the reach of a window and the length of a block, empty and short successors, wide characters
    lengths = [n for n in range(0, 60)] + [0, 200, 0, 247, 1, 252, 300, 22, 44, 45, 46, 90, 3]
    short = spark.createDataFrame([(i, "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(n))) for i, n in enumerate(rng.sample(lengths, len(lengths)))], "doc_id long, text string")
    for rows in (docs, edges, short):
        given_rows = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        texts = [(text[: len(text) - len(text) // 2] + given_rows[(k + 1) % len(given_rows)][1][: len(text) // 2]) for k, (_, text) in enumerate(given_rows)]
        every = spark.createDataFrame([(t,) for t in {*texts, *(t for _, t in given_rows)}], "text string")
        known = {r.text: (list(r.h), list(r.p)) for r in fingerprints.with_fingerprint(every, "text", "f").select("text", fingerprints.hashes("f").alias("h"), fingerprints.positions("f").alias("p")).collect()}

        def printed(text):
            return " ".join(f"{h:x}" for h in known[text][0])

        want = []
        for k, (i, text) in enumerate(given_rows):
            edited, after = texts[k], given_rows[(k + 1) % len(given_rows)][1]
            own, new = known[text], known[edited]
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(text), printed(edited), likeness(own[0], new[0]), likeness(own[0], known[after][0]), own[1], new[1]))
        result = fingerprints.op7_fingerprints(rows)
        assert not re.search("Python|Arrow|Pandas", result._jdf.queryExecution().toString())
        assert sorted((tuple(r) for r in result.collect()), key=repr) == sorted(want, key=repr)
    assert fingerprints.op7_fingerprints(edges.limit(0)).count() == 0


def test_decontamination(spark, docs, edges):
    bench = table(spark, SMALL, "benchmark")
    items = {r.item_id: b" " + b" ".join(T.words_of(r.text)) + b" " for r in bench.collect()}
    want = {(i, k) for i, t in texts_of(docs).items() for k, x in items.items() if x in b" " + b" ".join(T.words_of(t)) + b" "}
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(docs, bench).collect()}
    assert got == want
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "herons and mills by the river, five words and more", "x"), (3, "herons and mills by the river, five words and more", "y"), (4, "one", "z")], "item_id long, text string, score string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.op8_decontamination(edges, odd).collect())
    assert found == [(1, 3), (1, 3), (2, 3), (7, 4)]
    assert decontam.without_leaks(edges, odd).columns == edges.columns and decontam.without_leaks(edges, odd).count() == len(EDGES) - 4
    assert decontam.op8_decontamination(docs, odd.limit(0)).count() == 0


def test_decontamination_equals_all_windows(spark, tmp_path, monkeypatch):
    """Truncated, edited and rearranged passages, and short items inside long texts, against every window in SQL."""
    import compare

    monkeypatch.setattr(compare, "TABLES", ["documents", "benchmark"])
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11))) for _ in range(n)]

    items, texts = [], []
    for i in range(160):
        n = rng.choice([15, 20, 30, 50])
        item = words(n)
        items.append((i, " ".join(item)))
        cut = max(1, n // 10)
        texts.append(" ".join([*words(20), *words(cut), *item[cut:], *words(20)]))  # first words foreign
        texts.append(" ".join([*words(9), *item[: n - cut], *words(20)]))
        edited = list(item)
        edited[n // 2] = words(1)[0]
        texts.append(" ".join([*item[cut:], *words(5), *edited]))
    swapped = [words(40) for _ in range(5)]
    items += [(200 + k, " ".join(w)) for k, w in enumerate(swapped)]
    texts += [" ".join([*words(30), *w[20:], *w[:20], *words(30)]) for w in swapped]
    short = [words(k) for k in (1, 2, 3, 4)]
    items += [(300 + k, " ".join(w)) for k, w in enumerate(short)]
    texts += [" ".join([*words(30), *w, *words(30)]) for w in short] + [" ".join(w) for w in short]
    line = words(6)
    items.append((400, " ".join(line * 5)))  # repeated shingles count as often as the item has them
    texts += [" ".join(line * 5), " ".join([*words(3), *line, *line, *words(30)]), " ".join(line * 50), " ".join(line * 4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, bench = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "benchmark")
    found = saved(decontam.op8_decontamination(docs, bench), "test-leaks")
    assert compare.differences(spark, {"q": lambda s, d: found}, {"q": decontam.ORACLE}, "q", str(tmp_path)) == ""
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(480 + k, 200 + k) for k in range(5)} <= got  # swapped halves
    assert {(485 + k, 300 + k) for k in range(4)} | {(489 + k, 300 + k) for k in range(4)} <= got  # short items
    nameless = spark.createDataFrame([(None, items[0][1])], "item_id long, text string")
    assert {r.doc_id for r in decontam.op8_decontamination(docs, nameless).collect()} >= {0}


def test_sharding(spark, docs, edges):
    big = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"pair {i // 4}" if i % 2 else f"own {i}") for i in range(600)], "doc_id long, text string")
    for rows, n in ((docs, 200), (edges, len(EDGES)), (big, 600)):
        got = sharding.op9_sharding(rows).collect()
        assert len(got) == n
        sizes = {k: sorted(r.slot for r in got if r.shard == k) for k in range(40)}
        assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
        assert all(s == list(range(len(s))) for s in sizes.values())
        texts = rows.collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts), key=repr)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    pairs = {}
    for r in got:
        pairs.setdefault(r.text_crc32, set()).add(r.shard)
    groups = {zlib.crc32(f"pair {k}".encode()) for k in range(150)} & set(pairs)
    assert sum(len(pairs[g]) > 1 for g in groups) <= 0.1 * len(groups)  # few cut edges
    assert len(pairs[zlib.crc32(b"same")]) <= 36  # 200 rows need at least 14 shards of 15
    assert sharding.op9_sharding(edges.limit(0)).count() == 0


def test_sharding_gathers_large_groups(spark):
    half = [(i, "same" if i % 3 == 0 else f"pair {i // 4}" if i % 2 else f"own {i}") for i in range(600)]
    full = [(i, "same" if i < 200 else f"pair {i // 2}") for i in range(600)]
    for rows, cut in ((half, 0.02), (full, 0.15)):
        got = sharding.op9_sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        of, at = dict(rows), {}
        for r in got:
            at.setdefault(of[r.doc_id], set()).add(r.shard)
        linked = [t for t in at if t.startswith("pair")]
        assert len(at["same"]) <= -(-200 // 15) + 1
        assert sum(len(at[t]) > 1 for t in linked) <= cut * len(linked)


def test_flows_keep_quotas():
    assert sharding._flows({(0, 1): 3, (1, 0): 2}, [0, 0]) == {(0, 1): 2, (1, 0): 2}
    assert sharding._flows({(0, 1): 3, (1, 2): 2, (2, 0): 5}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert sharding._flows({(0, 1): 3, (1, 2): 4}, [0, 0, 1]) == {(0, 1): 1, (1, 2): 1}
    assert sharding._flows({(0, 1): 3}, [4, 0]) == {}


def test_toxicity_of_held_out(spark, docs, labels, edges, no_docs):
    rows = toxicity.op10_toxicity(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")).collect()
    known = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.9 * len(held)
    assert toxicity.op10_toxicity(edges, labels).count() == len(EDGES)
    assert toxicity.op10_toxicity(no_docs, labels).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (1, 0, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op10_toxicity(edges, odd).count() == len(EDGES)
    clean = toxicity.without_toxic(edges, toxicity.fit(edges, toxicity.training_rows(labels, False)))
    assert clean.columns == edges.columns


def test_interactions_of_terms(spark):
    """Two words that are harmless alone, and toxic together or both missing: no weight of a single word can tell."""
    rng, rows, known = random.Random(0), [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(60)}x" for _ in range(12)] + ["thatlot"] * a + ["vermin"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        known.append((i, 1, int(a == b)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.op10_toxicity(docs, labels).collect() if r.held_out]
    assert len(held) > 300 and sum((r.score >= 0.5) == (known[r.doc_id][2] == 1) for r in held) >= 0.95 * len(held)


def test_factorization_machine_equals_sums_over_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    slot = np.zeros(toxicity.N_BUCKETS, np.int32)
    slot[[5, 7, 9, 11]] = [1, 2, 3, 4]
    model = toxicity.Model(slot, np.concatenate(([0.0], rng.normal(size=4))), np.vstack((np.zeros((1, 3)), rng.normal(size=(4, 3)))), 0.1)
    texts = [[5, 7, 9], [11], [], [5, 7, 9, 11, 13]]  # 13 was never seen
    got = model.scores(4, np.repeat(np.arange(4), [len(t) for t in texts]), np.array([b for t in texts for b in t]))
    for t, s in zip(texts, got):
        at = [slot[b] for b in t if slot[b]]
        pairs = sum(model.factors[i] @ model.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(s - 1 / (1 + np.exp(-(0.1 + sum(model.weight[at]) + pairs / max(len(t), 1))))) < 1e-9

"""The operators held against brute force, round trips and edge cases: nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliolens.llm import chat, classifier, decontamination, html_text, pieces, pitman_yor, quality_rules, simhash, url_filters, warc

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- 1 ------------------------------------------------------------------------------------------


def judged(spark, urls, rules=url_filters.RULES):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    return {r.page_id: r for r in url_filters.judge_urls(pages, url_filters.rules_frame(spark, rules)).collect()}


def brute_judge(host, path, rules):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_url_rules_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "exxample.com", "net", "example.net", "org", "x-org", "de"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71?q", "/de/8#x", "/es/é", "/fr"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    rules = [*url_filters.RULES, ("a.example.com", "", "block"), ("example.com", "/", "allow"), ("com", "/en/71", "allow")]
    out = judged(spark, urls, rules)
    assert len(out) == len(urls)
    for r in out.values():
        assert (r.rule, r.verdict) == brute_judge(r.host, r.path, rules), r


def test_url_rules_are_those_of_the_contract(spark):
    assert set(url_filters.RULES) == {("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")}
    out = judged(spark, ["http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/7", "http://b.com/en/1", "http://example.com/en/7", "http://c.org/es/1", "http://a.net/en/1"])
    said = [(out[k].rule, out[k].verdict) for k in range(7)]
    assert said == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]


def test_url_parts_and_odd_urls(spark):
    out = judged(spark, ["HTTP://WWW.Example.COM/en/7?x", None, "no scheme", "", "http://", "http://h#f/x", "a://b://c/d", "http://Ünï.com/en/"])
    assert [(out[k].host, out[k].path) for k in range(8)] == [("www.example.com", "/en/7"), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("b:", "//c/d"), ("Ünï.com", "/en/")]
    assert out[0].verdict == "allow" and out[0].rule == "example.com/en/7" and out[7].verdict == "block" and out[1].rule is None
    assert judged(spark, []) == {}


# --- 2 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 100
    rows = [(1, "http://a", same), (2, "http://b", same), (3, None, same), (4, "u v\r\nX: y", "short"), (5, "w", "short"), (6, "n", None), (7, "n", ""), (8, "z", "WARC/1.1\r\n\r\n" * 20), (2, "http://b", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    raw = {(r.page_id, r.record_type): r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert bytes(raw[8, "response"].payload) == rows[7][2].encode() and raw[2, "revisit"].payload_bytes is None
    out = warc.resolved(warc.read_archives(spark, path)).collect()
    assert sorted(r.page_id for r in out) == [1, 2, 2, 3, 4, 5, 6, 7, 8]
    by = {r.page_id: r for r in out}
    for k, _, html in rows:
        data = (html or "").encode()
        assert by[k].payload_digest == hashlib.sha256(data).hexdigest() and by[k].payload_bytes == len(data)
        assert by[k].record_type == ("revisit" if k in (2, 3) else "response") and by[k].refers_to == (1 if k in (2, 3) else None)


# --- 3 ------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<header><h1>Site</h1></header><div class="sidebar"><p>Side words here</p></div>
<article><h1>Main &amp; title</h1><p>First   paragraph with
many words, <b>bold</b> ones too and a <a href=y>link</a>.</p><p>Second&nbsp;one &lt;x&gt; goes on for a while.</p><div class="ad">Buy</div></article>
<div class="comments"><p>A reader says hello to everybody here.</p></div><footer>Foot</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Main & title\nFirst paragraph with many words, bold ones too and a link.\nSecond one <x> goes on for a while."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<div><p>" + "long text. " * 20000 + "</p>").startswith("long text.")


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    out = html_text.extract_text(pages).collect()
    assert len(out) == 3 and all(r.n_chars == len(r.text) for r in out)


# --- 4 ------------------------------------------------------------------------------------------


def test_pitman_yor_learns_more_than_its_base(spark):
    rng = random.Random(4)
    rows = [(k, text_of(rng, rng.choice([0, 3, 40])) if k % 9 else None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    out = {r.doc_id: r for r in pitman_yor.score(docs, ~held, held, chunk_tokens=500).collect()}
    tokens = {k: (t or "").lower().split() + [None] for k, t in rows}
    seen = [w for k, t in tokens.items() if k % 7 != 2 for w in t]
    counts = {w: seen.count(w) for w in set(seen)}
    for k, t in tokens.items():
        base = sum(np.log10((counts.get(w, 0) + 1) / (len(seen) + len(counts) + 1)) for w in t)
        assert (out[k].n_tokens, out[k].n_known, out[k].train_tokens, out[k].held_out) == (len(t), sum(w in counts for w in t), len(seen), k % 7 == 2)
        assert abs(out[k].base_score - base) < 1e-6 and out[k].score < 0
    assert pitman_yor.score(docs.limit(0), ~held, held).collect() == []


def test_pitman_yor_probabilities_add_up_after_every_context():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    names = np.sort(rng.integers(1, 1 << 63, 31, dtype=np.uint64))  # the last one is never seen
    endings = np.array([97 << 8 | 98, 98 << 8 | 98, 97 << 8 | 99], np.uint16)
    contexts = np.array([97 << 8 | 98, 98 << 8 | 98, 97 << 8 | 99, *(pitman_yor.WORDS + k for k in range(3))], np.uint32)
    w, c = (x.ravel() for x in np.meshgrid(names, contexts, indexing="ij"))
    n = np.where(w == names[-1], 0, rng.integers(0, 90, len(w)) * rng.integers(0, 2, len(w))).astype(np.uint32)
    row = pitman_yor._merged(endings, pa.table({"bucket": pa.array([0], pa.int32()), "chunk": [5], "words": [w.tobytes()], "contexts": [pitman_yor._planes(c)], "counts": [pitman_yor._planes(n)]})).to_pylist()[0]
    own = pitman_yor._Bucket(row)
    own.start()
    place = pitman_yor._unplanes(row["place"], np.uint32)
    for tables in (None, [lambda n: np.maximum(n // 3, np.minimum(n, 1))] * 4):
        if tables:
            for level in reversed(pitman_yor.LEVELS):
                own.seated(level, tables[level](own.n[level]))
        sums = [np.zeros((4, size), np.int64) for size in pitman_yor._sizes(3)]
        own.add(sums)
        customers, seats = ([x[k] for x in sums] for k in (0, 1))
        p = own.probabilities([0.3, 0.4, 0.5, 0.6], customers, seats, 1 / len(names))[3][place]
        for context in contexts:
            assert abs(p[c == context].sum() - 1) < 1e-9
        assert (own.n[1].sum(), own.n[2].sum()) == (own.t[2].sum(), own.t[3].sum() + n[c < pitman_yor.WORDS].sum())


def test_pitman_yor_merges_buckets_in_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    chunks = []
    for k in range(40):  # one word in very many contexts of every chunk
        c = np.sort(rng.choice(200, 60, replace=False)).astype(np.uint32)
        chunks.append((k, np.full(60, 7, np.uint64), c, rng.integers(0, 5, 60).astype(np.uint32)))
    asked = pa.table({"bucket": pa.array([0] * 40, pa.int32()), "chunk": [k for k, *_ in chunks], "words": [w.tobytes() for _, w, _, _ in chunks], "contexts": [pitman_yor._planes(c) for _, _, c, _ in chunks], "counts": [pitman_yor._planes(n) for *_, n in chunks]})
    rows = [r for b in pitman_yor._buckets(np.zeros(0, np.uint16), 100, 300, iter(asked.to_batches())) for r in b.to_pylist()]
    assert len(rows) > 5 and all(len(r["place"]) // 4 <= 300 + 2 * 100 for r in rows)
    assert [r["context"] is None for r in rows] == [True] * (len(rows) - 1) + [False]
    context, n = pitman_yor._unplanes(rows[-1]["context"], np.uint32), pitman_yor._unplanes(rows[-1]["n"], np.uint32)
    assert len(context) == len(set(context)) == len(set(np.concatenate([c for _, _, c, _ in chunks])))
    wanted = np.zeros(200, np.int64)
    for _, _, c, k in chunks:
        wanted[c] += k
    assert (n == wanted[context]).all()
    place = np.concatenate([pitman_yor._unplanes(r["place"], np.uint32) for r in rows])
    assert (context[place] == np.concatenate([c for _, _, c, _ in chunks])).all()
    assert np.concatenate([np.frombuffer(r["chunks"], np.int64) for r in rows]).tolist() == list(range(40))

    # Scores do not depend on how many rows a bucket's places stand in.
    texts = [" ".join(rng.choice(["the", "a", *(f"w{k}" for k in range(30))], 40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    found = {}
    for parts in (1000, 0):
        monkeypatch.setattr(pitman_yor, "PARTS", parts)
        found[parts] = sorted(pitman_yor.score(docs, ~held, held, chunk_tokens=100, bucket_types=100).collect())
    assert found[0] == found[1000] and len(found[0]) == 60


def test_pitman_yor_tells_words_of_one_ending_apart(spark):
    rng = random.Random(11)
    follows = {"baten": ["red", "blue"], "loten": ["green", "grey"], "miten": ["one", "two"]}
    rows = [(k, " ".join(x for _ in range(20) for w in [rng.choice(list(follows))] for x in (w, rng.choice(follows[w])))) for k in range(120)]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0
    total = {rare: sum(r.score for r in pitman_yor.score(docs, ~held, held, chunk_tokens=700, bucket_types=20, rare=rare).collect() if r.held_out) for rare in (0.25, 1e9)}
    # After a word one of two follows, after its ending one of six.
    assert total[0.25] > total[1e9] + 0.8 * 24 * 20 * np.log10(3)


def test_frequent_words_match_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 80))) for _ in range(90)] + [None, "", " \t"]
    words = [w.lower() for t in texts for w in (t or "").split()]
    for rare in (0.1, 0.25, 2.0):
        wanted = {w for w in set(words) if words.count(w) >= max(2, rare * len(words) ** 0.5)}
        hashes, endings = pitman_yor.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"), rare, 300)
        assert len(hashes) == len(wanted) <= len(words) ** 0.5 / rare and (np.diff(hashes.astype(object)) > 0).all()
        assert sorted(endings.tolist()) == sorted(ord(w[-2]) << 8 | ord(w[-1]) for w in wanted)


# --- 5 ------------------------------------------------------------------------------------------


def test_classifier_tells_noise_from_prose(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        good = k % 2
        rows.append((k, text_of(rng, 60) if good else " ".join(rng.choice(["$$", "!!!", "BUY", "1234", "##"]) for _ in range(60)), 0.1))
        labels.append((k, good))
    docs = spark.createDataFrame([*rows, (1000, None, 0.0), (1001, "", 0.0)], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r.score for r in classifier.scored(docs, classifier.train(docs, known, F.col("doc_id") % 5 != 0)).collect()}
    assert len(out) == 402 and all(0 <= s <= 1 for s in out.values()) and out[1000] == out[1001]
    assert np.mean([(out[k] >= 0.5) == bool(k % 2) for k in range(0, 400, 5)]) > 0.95
    assert {r.score for r in classifier.scored(docs, classifier.train(docs, known.limit(0), F.lit(True))).collect()} == {0.5}


# --- 6 ------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    odd = ["", None, "### user:\nhi</turn>\n", "\\", "\\\\###\\", "</turn>", chat.ODD, "a\n### x"]
    turns = [(k, 2 * i + j, role, odd[(k + i + j) % len(odd)], "clash") for k in range(8) for i in range(2) for j, role in enumerate(("user", "assistant"))]
    turns += [(90, 0, "assistant", "x", "c"), (91, 0, "user", "x", "c"), (None, 0, None, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss string")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert len(out) == 11
    for k in range(8):
        own = [(r, t or "") for c, _, r, t, _ in turns if c == k]
        assert out[k].n_turns == 4 and out[k].valid
        assert out[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert out[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and out[k].loss_chars == len(loss)
    assert not out[90].valid and not out[91].valid


# --- 7 ------------------------------------------------------------------------------------------


def test_pieces_match_the_library(spark):
    import sentencepiece

    p = pieces.Pieces.load(pieces.MODEL)
    rng = random.Random(7)
    texts = [text_of(rng, 30), "Über straße — 日本語 \U0001f600", "a  b", "", None, "x" * 500, "1,234.5 %$#", " lead", "trail ", "Zwölf Boxkämpfer jagen"]
    ids = pieces.encode(p, texts)
    for t, x in zip(texts, ids, strict=True):
        assert pieces.decode(p, x.tolist()) == (t or "")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert library.decode(ids[0].tolist()) == texts[0]
    out = pieces.decoded(pieces.encoded(spark.createDataFrame([(1, texts[0], "x"), (2, None, "y")], "doc_id long, text string, ids string"), p), p).collect()
    assert [r.decoded for r in sorted(out, key=lambda r: r.doc_id)] == [texts[0], ""]


# --- 8 ------------------------------------------------------------------------------------------


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "  \n\t", "a b c a b c", "a a a a", "x\ny\nx\n x\n\nx", "# é\u00a0é *", "\U0001f600 b"] + ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, rule string")
    for r in quality_rules.judge(docs, []).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_counts(texts[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and r.kept == (not r.base_failed)


def test_decision_list_is_learned_and_applied():
    rng = random.Random(9)
    rows = [dict.fromkeys(quality_rules.FEATURES, 0.5) | {"symbol_rate": rng.uniform(0.3, 1) if bad else rng.uniform(0, 0.2), "good": not bad, "held": k % 3 == 0} for k in range(200) for bad in [k % 4 == 0]]
    rules = quality_rules.learn(rows)
    assert rules and all(any(r.fits(x) for r in rules) != x["good"] for x in rows)
    assert quality_rules.learn([]) == []


# --- 9 ------------------------------------------------------------------------------------------


def brute_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_edit_matches_equal_brute_force(spark):
    rng = random.Random(10)
    items = [(k, text_of(rng, rng.choice([3, 12, 30]))) for k in range(12)] + [(50, None), (51, "  "), (52, text_of(rng, 12))]
    texts = []
    for _ in range(120):
        body = text_of(rng, 30)
        item = rng.choice(items)[1] or ""
        for _ in range(rng.randrange(0, 8)):
            i = rng.randrange(len(item) + 1)
            item = item[:i] + rng.choice(["", "x", "q "]) + item[i + rng.randrange(2) :]
        texts.append(f"{body} {item.upper() if rng.random() < 0.2 else item}  {text_of(rng, 5)}")
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, hits int")
    out = decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string"), block=200)
    for r in out.collect():
        want = []
        for i, item in items:
            item = decontamination.normal(item)
            if item:
                d = brute_distance(item, decontamination.normal(r.text))
                if d <= decontamination.budget(len(item)):
                    want.append((i, d))
        assert sorted((h.item_id, h.distance) for h in r.hits) == want


# --- 10 -----------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash.links, "__defaults__", (crowded,))
    rng = random.Random(11)
    texts = [text_of(rng, 60) for _ in range(12)]
    for k in range(90):
        words = texts[k % 12].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "ONE", "one two"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, fp int")
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] > root[j]:
                    root[i], changed = root[j], True
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hexed("fp").alias("h"), "component_id").collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert r.h == f"{prints[r.doc_id]:016x}" and r.component_id == root[r.doc_id]


def test_links_find_all_pairs_within_two_bits(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for b in base for _ in range(8)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(frame).collect()}
    want = {(a, b) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert quality_rules.judge(docs, quality_rules.learn_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect() == []
    assert decontamination.matches(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


# --- ids of any size, nulls, repeats, long texts, clashing names -----------------------------------


def test_url_ids_are_returned_as_they_are(spark):
    ids = [2**53 + k for k in range(12)] + [2**62 + 1, -5, None, None]
    pages = spark.createDataFrame([(k, f"http://a{n % 3}.example.com/en/7{'x' * n}") for n, k in enumerate(ids)] + [(7, "http://example.net/de/8")] * 3, "page_id long, url string")
    out = url_filters.judge_urls(pages, url_filters.rules_frame(spark)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.page_id for r in out), key=key) == sorted([*ids, 7, 7, 7], key=key)
    assert all(r.rule == ("example.net/de/8" if r.page_id == 7 else "example.com/en/7") for r in out)


def test_url_rules_that_are_odd(spark):
    rules = spark.createDataFrame([("h.x", None, "block"), (None, "/", "block"), ("", "/", "block"), ("i.x", "/", "allow"), ("i.x", "/", "block"), ("j.x", "/", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate(["http://h.x", "http://i.x/", "http://j.x/", "http://" + "long." * 3000 + "h.x/" + "p" * 100_000])], "page_id long, url string, verdict string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert out == {0: ("h.x", "block"), 1: ("i.x/", "block"), 2: (None, "allow"), 3: ("h.x", "block")}
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_equal_urls_are_sampled_within_bounds(spark):
    pages = spark.range(60_000).select(F.lit(1).cast("long").alias("page_id"), F.lit("http://example.com/en/7").alias("url"))
    out = url_filters.judge_urls(pages, url_filters.rules_frame(spark))
    assert out.groupBy("page_id", "rule", "verdict").count().collect() == [(1, "example.com/en/7", "allow", 60_000)]


def test_warc_urls_and_missing_ids(spark, tmp_path):
    same = "x" * 150
    urls = ["a/b%20c", "%250", "%25", "% 0", "a%0Ab\r\n", "\x00%00", "é %é"]
    rows = [(k, u, f"{k}") for k, u in enumerate(urls)] + [(None, "n1", same), (None, "n2", same), (50, "m", same), (None, "l", "y" * 150)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path).collect()
    assert sorted(r.url for r in records) == sorted(u for _, u, _ in rows)
    out = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(warc.read_archives(spark, path)).collect())
    assert out[:3] == [(-1, "response", None, 150), (-1, "revisit", 50, 150), (-1, "revisit", 50, 150)] and out[-1] == (50, "response", None, 150)
    warc.write_archives(pages.limit(0), f"{path}0")
    assert warc.resolved(warc.read_archives(spark, f"{path}0")).collect() == []


def brute_density(page):
    """Density of each node by its definition, from counts of its whole subtree."""
    import math

    t = html_text._parse(page)
    kids = {k: [j for j in range(len(t.tag)) if t.parent[j] == k and not t.gone[j]] for k in range(len(t.tag))}
    below = lambda k: [k] + [j for c in kids[k] for j in below(c)]
    up = lambda k: [k] + (up(t.parent[k]) if t.parent[k] >= 0 else [])
    own = [sum(len(" ".join(s.split())) for n, _, s in t.texts if n == k) for k in range(len(t.tag))]
    linked = [any(t.tag[j] == "a" or t.named[j] for j in up(k)) for k in range(len(t.tag))]
    count = lambda k: (sum(own[j] for j in below(k)), sum(own[j] for j in below(k) if linked[j]), len(below(k)) - 1, sum(t.tag[j] == "a" for j in below(k)[1:]))
    body = next(k for k in range(len(t.tag)) if t.tag[k] == "body")
    share = count(body)[1] / count(body)[0]
    out = []
    for k in range(len(t.tag)):
        c, lc, n, lt = count(k)
        if t.gone[k] or not c or c > 1 and lc >= c:
            out.append(0.0)
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        out.append(c / max(1, n) * max(0.0, math.log(c / max(1, lc) * max(1, n) / max(1, lt))) / base)
    return t, own, out


def test_densities_equal_their_definition():
    t, own, want = brute_density(PAGE)
    got, _ = html_text.node_densities(t.parent, t.tag, t.gone, t.named, own)
    assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_density_decides_what_is_content(monkeypatch):
    page = "<body><div><ul>" + "<li><a href=x>Go there</a></li>" * 9 + "</ul></div><div><p>" + "Words of the text, and more of them. " * 5 + "</p><p>" + "A second part with its own words. " * 5 + "</p></div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Words of") and "Go there" not in text and text.count("\n") == 1
    monkeypatch.setattr(html_text, "node_densities", lambda *x, f=html_text.node_densities: ([1.0] * len(x[1]), f(*x)[1]))
    assert html_text.main_text(page) != text and "Go there" in html_text.main_text(page)


def test_names_that_only_sound_like_adverts_stay():
    text = "Text of the article goes here, and on it goes for long. " * 4
    page = f"<article><p>{text}</p><div class='share-price'><p>{text}</p></div><div id='alert-rules'>{text}</div><div class='comments'><p>{text}</p></div></article>"
    assert html_text.main_text(page).count("\n") == 2


def test_deep_and_broken_pages_take_linear_time():
    import time

    for page in ("<div>" * 60_000 + "</p>x" * 60_000, "<b>" * 60_000 + "<div><i>" * 60_000 + "</b>" * 60_000, "<table><tr><td>" * 30_000 + "x"):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20


def test_probabilities_of_the_language_model_are_below_one(spark):
    docs = spark.createDataFrame([(None, "a b a b"), (None, "a b a b"), (3, "word " * 50_000), (3, "word"), (4, "unseen words here")], "doc_id long, text string")
    out = pitman_yor.score(docs, F.coalesce(F.col("doc_id") != 4, F.lit(True)), F.coalesce(F.col("doc_id") == 4, F.lit(False)), chunk_tokens=1000).collect()
    assert len(out) == 5 and sorted((r.doc_id or 0) for r in out) == [0, 0, 3, 3, 4] and all(r.score < 0 for r in out)
    assert out[0].train_tokens == 5 + 5 + 50_001 + 2


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(k, ("good words of prose " if k % 2 else "### $$$ 123 ") * 20) for k in range(60)] + [(None, "x")] * 2 + [(1, "huge " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels, F.lit(True), 40)
    assert model[1] is not None and classifier.scored(docs, model).count() == 63 and classifier.scored(docs.limit(0), model).count() == 0


def test_conversations_edge_cases(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "user", "b"), (2, 1, "assistant", "c" * 300_000)]
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, kind))).collect()}
    assert out[1].n_turns == 2 and out[2].n_turns == 2 and out[2].loss_chars == 300_000


def test_pieces_give_the_ids_of_the_library(spark):
    import sentencepiece

    library, p, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Pieces.load(pieces.MODEL), random.Random(17)
    texts = ["Über straße — 日本語 \U0001f600", "a  b", "x" * 500, "1,234.5 %$#", " lead", "trail ", "日本語の文章です。" * 300, "aaaaabbbb" * 100, "\n\n\t x y", "the   the    end", "中文字符" * 20, "def f(x):\n    return x+1\n", "\x00\x01 ​"]
    texts += ["".join(rng.choice("abcdethinrs  .\nßé日") for _ in range(rng.randrange(1, 300))) for _ in range(200)] + [text_of(rng, 50) for _ in range(50)]
    for t, ids in zip(texts, pieces.encode(p, texts), strict=True):
        assert ids.tolist() == library.encode(t) and pieces.decode(p, ids.tolist()) == t
    assert spark.createDataFrame([], "doc_id long, text string").count() == pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), p).count() == 0


def test_viterbi_finds_the_best_sum():
    from itertools import product

    rng = random.Random(18)
    vocabulary = sorted({"".join(x) for n in (1, 2, 3) for x in product("ab", repeat=n) if n == 1 or rng.random() < 0.6})
    names = [f"<{b:02X}>" for b in range(256)] + vocabulary
    scores = [0.0] * 256 + [-rng.random() * 9 for _ in vocabulary]
    p = pieces.Pieces(names, scores, list(range(256)), set())
    known = dict(zip(vocabulary, scores[256:], strict=True))

    def best(u):
        return 0.0 if not u else max(known[u[:n]] + best(u[n:]) for n in range(1, len(u) + 1) if u[:n] in known)

    for n in range(1, 9):
        units = ["".join(rng.choice("ab") for _ in range(n)) for _ in range(20)]
        ids, counts = pieces.best_pieces(p, units)
        for u, end, size in zip(units, np.cumsum(counts), counts, strict=True):
            own = [names[i] for i in ids[end - size : end]]
            assert "".join(own) == u and abs(sum(known[x] for x in own) - best(u)) < 1e-9


def test_quality_base_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(quality_rules.BASE_SQL).fetchall()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), []).collect()}
    assert got == want


def test_short_items_and_blocks(spark):
    docs = spark.createDataFrame([(1, "the cat sat on a mat"), (None, "a long enough passage to be found, said she"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "the"), (3, "a long enough passage to be found"), (4, "A LONG enough passage too be found"), (4, "A LONG enough passage too be found")], "item_id long, text string")
    out = {(r.doc_id, r.text): [h.item_id for h in r.hits] for r in decontamination.matches(docs, items, block=30).collect()}
    assert out == {(1, "the cat sat on a mat"): [], (None, "a long enough passage to be found, said she"): [3, 4], (None, None): []} or sorted(out[None, "a long enough passage to be found, said she"]) == [3, 4]


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, None), (9, "x y z"), (4, " "), (2**60, "w " * 100_000)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert out == [(0, 4), (0, 9), (0, 9), (4, 4), (9, 9), (2**60, 2**60)]


def test_shared_folder_has_to_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from foliolens.llm import common

    bare = lambda master, dir=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: dir))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(bare("spark://host:7077"))
    assert common.shared_dir(bare("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y" and common.shared_dir(bare("local[2]")).startswith("file:///")

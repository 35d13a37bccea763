"""Each operator against a brute-force version, with the odd inputs its docstring defines."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, ngram_join, ppm, quality_classifier, quality_rules, queries, quotation, topk_join, url_filter, warc_store
from palimpsest.llm.components import components
from palimpsest.llm.sentencepiece_codec import codec, decode_column, encode_column, token_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0) for i, t, s in rows], DOC)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1. SentencePiece


def test_codec_equals_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL), codec(queries.MODEL)
    rng = random.Random(3)
    letters = [*"  ▁abcdetnhio\n\x00éß中😀ñ�1", "  ", "th", " the", "ing", "<s>", "<0x0A>"]
    texts = ["", " ", "   ", "a" * 3000, "th" * 2000, " " * 500 + "x" * 300, "中文字符" * 900, "!?…" * 700] + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert own.encode(t, add_eos=True) == lib.encode(t, add_eos=True)
        assert own.decode(own.encode(t)) == lib.decode(lib.encode(t))
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == lib.decode(ids)


def test_codec_columns(spark):
    df = docs(spark, [(1, "Hello  wörld", "a"), (2, None, "a"), (2, None, "a"), (3, "", "b")])
    out = decode_column(encode_column(df, queries.MODEL), queries.MODEL, text="back").collect()
    assert sorted((r.doc_id, r.back) for r in out) == [(1, "Hello  wörld"), (2, ""), (2, ""), (3, "")]
    digests = token_digests(df, queries.MODEL).collect()
    assert Counter(r.n_tokens for r in digests)[1] == 3
    assert {r.ids_sha256 for r in digests if r.doc_id > 1} == {hashlib.sha256(b"2").hexdigest()}
    assert token_digests(df.limit(0), queries.MODEL).count() == 0


# --- 2. Top-k


@pytest.mark.parametrize("copies", [0, 40])
def test_topk(spark, copies):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8)).round(3)
    rows = [(i, [float(c) for c in v], 7) for i, v in enumerate(vectors)]
    rows += [(200 + i, rows[3][1], 7) for i in range(copies)]
    rows += [(900, None, 1), (950, [1.0] * 7 + [None], 1), (1000, [1.0] * 7 + [float("nan")], 1), (1050, [float("inf")] * 8, 1), (1100, [1.0] * 3, 1), (1150, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk_join.topk(df.where("vec_id % 10 = 0"), df, pivots=5).collect()
    good = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows if i < 900}
    want = []
    for q in (i for i in good if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_join.topk(df.limit(0), df).count() == 0
    assert topk_join.topk(df.where("vec_id = 0"), df.where("vec_id < 3")).count() == 2


def test_topk_searches_each_length_and_each_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=n).round(3)]) for i, n in enumerate([8] * 60 + [5] * 40)] + [(200, [1.0] * 9), (210, []), (211, [])]
    rows += [(i, [float(c) for c in rng.normal(size=8).round(3)]) for i in (3, 3, 10, 20, 20)] + [rows[5]] * 3 + [rows[30]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in good if i % 10 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for j, u in good if j == q for i, v in good if i != q and len(u) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, topk_join.topk(df.where("vec_id % 10 = 0"), df, pivots=5).collect())) == sorted(want)


@pytest.mark.parametrize("scale", [1.0, 1e17])
def test_topk_in_clusters_and_small_blocks(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_join, "_DATA_BLOCK", 16)
    monkeypatch.setattr(topk_join, "_QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 10
    vectors = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6)) * 0.3).round(2) * scale
    df = spark.createDataFrame([(i, [float(c) for c in v], "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, units string")
    good = [[math.floor(256 * c) for c in v] for v in vectors]
    want = []
    for q in range(0, 600, 10):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in enumerate(good) if i != q)[:5]
        want += [(q, k + 1, i, min(-s, (1 << 63) - 1)) for k, (s, i) in enumerate(scores)]
    got = topk_join.topk(df.where("vec_id % 10 = 0"), df).collect()
    if scale == 1.0:
        assert sorted(map(tuple, got)) == sorted(want)
    else:  # beyond 64 bits: equal scores go to the smaller key
        assert len(got) == len(want) and all(r.score == (1 << 63) - 1 for r in got)


# --- 3. Classifier


def test_classifier(spark):
    rng = random.Random(5)
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join(rng.choice(["a###", "b$$$", "c%%%"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", "s"), (902, "w1 " * 50_000, "s")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210) if i % 3] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    own = quality_classifier.featured(df)
    judged = lambda x, m: quality_classifier.score(x, m).select("row.*", "text_score", "meta_score", "score", "kept")
    got = by(judged(own, quality_classifier.fit(own, labels)), "doc_id")
    assert len(got) == len(rows)
    held = [i for i in range(210) if i % 3 == 0]
    assert sum(got[i]["kept"] == (i < 150) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = judged(own, quality_classifier.fit(own, labels.where("quality = 1")))
    assert none.where("not kept").count() == 0
    assert judged(quality_classifier.featured(df.limit(0)), quality_classifier.fit(own, labels)).count() == 0
    assert quality_classifier.fit(quality_classifier.featured(df.limit(0)), labels) is None


# --- 4. URLs


def test_urls(spark):
    urls = ["http://Blog.Example.COM/en/7x?q", "https://example.com/en/8", "http://notexample.com/en/7", "ftp://a.example.net/de/8", "x://net/de/", "http://a.org/es", "http://a.org/es/", None, "", "no scheme", "a://b://c/d", "http://h?x/en/", "http://h#f", "http://spam-farm.example.org/fr/1", "http://" + "h" * 300_000 + ".org/es/" + "p" * 300_000]
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "h", "clash")], "page_id long, url string, html string, host string")
    spam = url_filter.spam_hosts(df, queries.BLOCKED_LABELS)
    assert {r.host for r in spam.collect()} == {"spam-farm.example.org"}
    listed = spam.unionByName(spark.createDataFrame([("a.org",), ("a.org",), (None,), ("",), ("elsewhere",)], "host string"))
    got = url_filter.judge_urls(df, queries.URL_RULES, listed).collect()
    assert len(got) == len(df.collect())
    for r in got:
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        blocked = host in ("spam-farm.example.org", "a.org")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.text, best.verdict if best else "block" if blocked else "allow")
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES, listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, [], listed.limit(0)).collect()} == {"allow"}


def test_urls_beyond_the_bound_of_a_level(spark):
    urls = [f"http://{'spam-farm.' if i % 3 else ''}h{i}.org/{'es/' if i % 2 else ''}" for i in range(300)] * 2 + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.spam_hosts(df, queries.BLOCKED_LABELS)
    own = [sorted(map(tuple, url_filter.judge_urls(df, queries.URL_RULES, listed, max_bytes=n).collect())) for n in (20, 16 << 20)]
    assert own[0] == own[1] and {r[4] for r in own[0]} == {"allow", "block"}


@pytest.mark.parametrize("n", [0, 1, 300, 3000])
def test_cascade_is_exact(spark, n):
    universe = spark.range(3000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(3000)) < n).alias("listed")).cache()
    cascade = url_filter.BloomCascade.build(universe)
    assert universe.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
    with pytest.raises(ValueError):
        url_filter.BloomCascade.build(spark.range(90_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2 == 0).alias("listed")), max_bytes=100)
    joined = url_filter.listed_by_join(universe.select("key"), "key", universe.where("listed").select("key"))
    assert joined.where("listed").count() == universe.where("listed").count()


def test_levels_reach_the_driver_in_chunks(spark):
    universe = spark.range(600_000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).alias("listed"))
    cascade = url_filter.BloomCascade.build(universe, max_bytes=1 << 18)
    assert universe.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
    level = cascade.levels[0]
    pos = universe.where("listed").select(F.explode(F.array(*level.positions(F.col("key")))).alias("pos"))
    assert len(level.data) > 2 << 15 and url_filter._chunks(pos).count() == -(-len(level.data) // (1 << 15))
    few = spark.createDataFrame([(x,) for x in (0, 7, 8, 63, 64, 300_001)], "pos long")
    got = {r.chunk: bytes(r["data"]) for r in url_filter._chunks(few).collect()}
    want = bytearray(2 << 15)
    for x in (0, 7, 8, 63, 64, 300_001):
        want[x // 8] |= 1 << x % 8
    assert got == {0: bytes(want[: 1 << 15]), 1: bytes(want[1 << 15 :])}


# --- 5. Quotation


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nTuesday is fine."),
        (1, 1, "assistant", "> Shall we meet?\n> Tuesday  is FINE.\nYes."),
        (1, 2, "user", "> > Tuesday is fine.\n> Yes.\nGood."),
        (1, 3, "user", "New topic"),
        (1, 4, "user", ">never said\nHm"),
        (1, 5, "assistant", "> New topic\nTell me"),
        (2, 0, "user", None), (2, 1, "user", ""), (2, 1, "user", ""), (None, 1, "user", "> x"), (3, None, "user", "> x"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, link string")
    out = quotation.link_quotes(df).collect()
    assert len(out) == len(rows)
    got = {r.turn: r for r in out if r.conv_id == 1}
    assert got[1].reply_text == "Yes." and (got[1].parent_turn, got[1].thread_turn, got[1].reply_depth) == (0, 0, 1)
    assert (got[2].n_passages, got[2].n_linked, got[2].parent_turn, got[2].thread_turn, got[2].reply_depth) == (2, 2, 1, 0, 2)
    assert (got[4].n_linked, got[4].parent_turn, got[4].thread_turn) == (0, None, 4)
    assert got[4].reply_text == ">never said\nHm"
    assert got[5].parent_turn == 3
    assert quotation.link_quotes(df.limit(0)).count() == 0
    assert quotation.conversations(df.limit(0)).count() == 0


_QUOTE = re.compile(r"[ \t]*(?:>[ \t]*)+")


def quote_units(text):
    normal = lambda x: re.sub(r"\s+", " ", x.lower()).strip(" ")
    sentences = lambda x: [y for y in re.split(r"(?<=[.!?]) ", x) if len(y.split(" ")) >= 4]
    return normal, sentences


def brute_quotes(rows):
    """turn -> (reply, parent, passages, linked) of one conversation, one message a turn, by plain loops."""
    normal, sentences = quote_units("")
    said, out = {}, {}
    for turn, text in sorted(rows):
        fence, passages, kept = False, [], []
        for line in re.split(r"\r?\n", text):
            if re.match(r"[ \t]*```", line):
                fence = not fence
                level = 0
            else:
                level = 0 if fence or not _QUOTE.match(line) else _QUOTE.match(line)[0].count(">")
            if level and passages and passages[-1][0] == level and kept and kept[-1][0] == len(passages) - 1:
                passages[-1][1].append(_QUOTE.sub("", line, count=1))
            elif level:
                passages.append((level, [_QUOTE.sub("", line, count=1)]))
            kept.append((len(passages) - 1 if level else None, line))
        latest = lambda unit: max((t for t, known in said.items() if unit in known), default=None)
        shares, n_linked, gone, blank_stays = {}, 0, {}, {}  # gone: (passage, line) -> raw pieces left
        for k, (level, lines) in enumerate(passages):
            pieces = [(i, raw) for i, line in enumerate(lines) for raw in re.split(r"(?<=[.!?])\s+", line.strip(" \t\r\n\x0b\f")) if normal(raw)]
            if not pieces:
                continue
            taken = {}  # place of a piece -> link
            hit = latest(normal(" ".join(lines)))
            if hit is not None:
                taken, n_linked = dict.fromkeys(range(len(pieces)), hit), n_linked + 1
            else:
                filled = sorted({i for i, _ in pieces})
                hits = [latest(normal(lines[i])) for i in filled]
                for x, i in enumerate(filled):
                    beside = any(0 <= y < len(filled) and hits[y] is not None for y in (x - 1, x + 1))
                    if hits[x] is not None and (len(normal(lines[i]).split(" ")) >= 4 or beside):
                        taken |= {p: hits[x] for p, (at, _) in enumerate(pieces) if at == i}
                        n_linked += 1
                begin = 0
                for p, (_, raw) in enumerate(pieces):
                    if raw[-1:] in ".!?" or p + 1 == len(pieces):
                        sentence = " ".join(normal(x) for _, x in pieces[begin : p + 1])
                        hit = latest(sentence) if len(sentence.split(" ")) >= 4 else None
                        new = [x for x in range(begin, p + 1) if hit is not None and x not in taken]
                        taken |= dict.fromkeys(new, hit)
                        n_linked += bool(new)
                        begin = p + 1
            for p, link in taken.items():
                by = shares.setdefault(level == 1, {})
                by[link] = by.get(link, 0) + len(normal(pieces[p][1]).split(" "))
            for p, (i, raw) in enumerate(pieces):
                stay = gone.setdefault((k, i), [[], 0])
                stay[1] += 1
                if p not in taken:
                    stay[0].append(raw)
            blank_stays[k] = len(taken) < len(pieces)
        best = shares.get(True) or shares.get(False) or {}
        parent = max(best, key=lambda t: (best[t], t), default=None)
        reply, at = [], {}
        for k, line in kept:
            i = at[k] = at.get(k, -1) + 1
            if k is None or (k, i) not in gone:
                left = [line] if k is None or blank_stays.get(k, True) else []
            elif len(gone[k, i][0]) == gone[k, i][1]:
                left = [line]
            else:
                left = [_QUOTE.match(line)[0] + " ".join(gone[k, i][0])] if gone[k, i][0] else []
            reply += left
        out[turn] = ("\n".join(reply).strip(" \t\r\n"), parent, sum(any(normal(x) for x in lines) for _, lines in passages), n_linked)
        own = "\n".join(line for k, line in kept if k is None)
        paragraphs = re.split(r"\r?\n[ \t]*\r?\n", own)
        said[turn] = {normal(own), *map(normal, paragraphs), *map(normal, re.split(r"\r?\n", own)), *(y for x in paragraphs for y in sentences(normal(x)))}
    return out


def test_quotes_keep_what_is_found_nowhere(spark):
    rows = [
        (1, 0, "ok"), (1, 1, "> ok\n> a wholly new line that nobody said before\n> and one more unfounded line\nmy answer"),
        (2, 0, "yes"), (2, 1, "> Dear all,\n> yes\n> the contract value is 5 million\nfine"),
        (3, 0, "The cat sat on the mat today."), (3, 1, "> The cat sat on the mat today. And the secret code is 1234 never quoted.\nhm"),
        (4, 0, "First line has five words.\nok\nthanks"), (4, 1, "> new words that are nowhere else\n> ok\n> thanks\n>\n> First line has five words.\nseen"),
        (5, 0, "one two three four"), (5, 1, "five six seven eight nine"), (5, 2, "> one two three four\n> five six seven eight nine\n> what nobody said\nboth"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotes(df).collect()}
    assert (got[1, 1].reply_text, got[1, 1].parent_turn, got[1, 1].n_linked) == (rows[1][2], None, 0)
    assert got[2, 1].reply_text == rows[3][2]
    assert (got[3, 1].reply_text, got[3, 1].parent_turn) == ("> And the secret code is 1234 never quoted.\nhm", 0)
    assert (got[4, 1].reply_text, got[4, 1].n_linked) == ("> new words that are nowhere else\n>\nseen", 3)
    assert (got[5, 2].reply_text, got[5, 2].parent_turn, got[5, 2].n_linked) == ("> what nobody said\nboth", 1, 2)


def chat(seed, n, hot=0.3):
    """Messages that quote earlier ones: whole, by line or sentence, nested, rewrapped, inside code, or nothing ever said."""
    rng, rows = random.Random(seed), []
    for turn in range(n):
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2]) if rows else 0):
            old = rows[0 if rng.random() < hot else rng.randrange(len(rows))][1]
            how = rng.randrange(6)
            if how == 0:
                old = rng.choice(old.split("\n"))
            elif how == 1:
                old = rng.choice(re.split(r"(?<=[.!?])\s", old))
            elif how == 2:
                old = old.replace(" ", "\n", 2).upper()
            elif how == 3:
                old = "never said by anyone here. " + str(turn)
            quote = "\n".join(rng.choice(["> ", ">", " > "]) + line for line in old.split("\n"))
            parts.append(f"```\n{quote}\n```" if how == 4 else quote)
        parts += [f"Message {turn} says number {rng.randrange(9)} today. Then it says more about {turn % 7} things!\nSecond line {turn}"] * rng.randrange(1, 3)
        rows.append((turn * 5, "\n".join(parts)))
    return rows


def test_quotes_brute(spark):
    chats = {1: chat(1, 60), 2: chat(2, 300, 0.9), 3: chat(3, 40, 0.0)}
    df = spark.createDataFrame([(c, t, "u", x) for c, rows in chats.items() for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotes(df).collect()}
    built = {}
    for r in sorted(quotation.conversations(df).collect(), key=lambda r: (r.conv_id, r.part)):
        assert r.piece == 0 and r.n_messages == len(r.messages)
        built.setdefault(r.conv_id, []).extend(r.messages)
    for c, rows in chats.items():
        want = brute_quotes(rows)
        children, order = {}, []
        for turn, (reply, parent, passages, linked) in want.items():
            r = got[c, turn]
            assert (r.reply_text, r.parent_turn, r.n_passages, r.n_linked) == (reply, parent, passages, linked)
            children.setdefault(parent, []).append(turn)

        def walk(turn, root, depth, children=children, order=order):
            order.append((turn, root, depth))
            for x in children.get(turn, []):
                walk(x, root, depth + 1)

        for x in children[None]:
            begin = len(order)
            walk(x, x, 0)
            for place, (turn, root, depth) in enumerate(order[begin:]):
                r = got[c, turn]
                assert (r.thread_turn, r.reply_depth, r.thread_place) == (root, depth, place)
        assert [(m.place, m.turn, m.text) for m in built[c]] == [(k, t, want[t][0]) for k, (t, _, _) in enumerate(order)]


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, "u", "late"), (None, 3, "u", "x"), (None, None, None, None), (2, 7, "u", "long " * 200_000)] + [(3, 1, "u", f"m{i}") for i in range(9000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    got = quotation.conversations(df).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.conv_id, []).extend(m.text for m in r.messages)
        assert r.n_messages < 4096 * 2
    assert texts[1] == ["a", "late"] and sorted(texts[None]) == ["", "x"] and texts[2] == [("long " * 200_000).strip()]
    assert len(texts[3]) == 9000 and sum(r.conv_id == 3 for r in got) == 3


def test_quotes_link_to_the_latest_across_blocks(spark):
    rows = [(1, t, "u", "same words" if t % 700 == 0 else f"m{t}") for t in range(1500)] + [(1, 1500, "u", "> same words\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert quotation.link_quotes(df).where("turn = 1500").first().parent_turn == 1400


# --- 6. Quality rules


def brute_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_stats(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "one", "a b\n\na b\na b ", "😀# é|\x1c x\x0by", "w " * 30, prose(1, 7), prose(2, 8)]
    texts += [" ".join(rng.choice("ab") + ("\n" if rng.random() < 0.2 else "") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [prose(4, 3000, 50), prose(5, 40) + " " + prose(5, 40)]
    got = by(quality_rules.with_stats(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])), "doc_id")
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality_rules.STATS) == brute_stats(t), t


def test_rules(spark):
    rng = random.Random(7)
    rows = [(i, prose(i, 50) if i % 4 else " ".join(f"x{rng.randrange(500)}###" for _ in range(50)), "s") for i in range(200)] + [(900, None, "s")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit_rules(df, labels)
    assert rules and all(str(r) for r in rules)
    got = by(quality_rules.judge(df, rules).select("row.*", "base_failed", "kept"), "doc_id")
    assert all(got[i]["kept"] == (i % 4 > 0) for i in range(200))
    assert got[900]["base_failed"] and not got[900]["kept"]
    assert quality_rules.fit_rules(df, labels.limit(0)) == []
    assert quality_rules.judge(df.limit(0), rules).count() == 0
    twice = df.union(df).union(df.where("doc_id = 0"))
    assert quality_rules.fit_rules(twice, labels) == rules
    assert quality_rules.judge(df, rules).where("kept").count() == sum(r["kept"] for r in got.values())


def literal_covering(rows, bad, prune, max_rules=8, most=4, precision=0.95, least=5):
    """Sequential covering by plain loops: every condition at every middle between neighbouring values."""
    names = list(rows[0])
    cuts = {}
    for n in names:
        own = sorted({r[n] for r in rows})
        cuts[n] = [(a + b) / 2 for a, b in zip(own, own[1:])]
        assert len(cuts[n]) <= 256
    holds = lambda c, r: r[c[0]] > c[2] if c[1] else r[c[0]] <= c[2]
    left, out = list(range(len(rows))), []
    while len(out) < max_rules and any(bad[i] for i in left):
        grow, held = [i for i in left if not prune[i]], [i for i in left if prune[i]]
        rule, inside = [], grow
        while len(rule) < most:
            p = sum(bad[i] for i in inside)
            if not p or p == len(inside):
                break
            best = (1e-9, None)
            for n in names:
                for above in (False, True):
                    own = (0.0, None)
                    for cut in cuts[n]:
                        hit = [i for i in inside if holds((n, above, cut), rows[i])]
                        k = sum(bad[i] for i in hit)
                        gain = k * (math.log2(k / len(hit)) - math.log2(p / len(inside))) if k else -1
                        if own[1] is None or gain > own[0]:
                            own = (gain, (n, above, cut))
                    if own[1] and own[0] > best[0]:
                        best = own
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [i for i in inside if holds(best[1], rows[i])]
        if not rule:
            break

        def worth(k, rule=rule, held=held):
            hit = [i for i in held if all(holds(c, rows[i]) for c in rule[:k])]
            return (2 * sum(bad[i] for i in hit) - len(hit)) / len(hit) if hit else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = [i for i in left if all(holds(c, rows[i]) for c in rule)]
        k = sum(bad[i] for i in hit)
        if k < least or k / len(hit) < precision:
            break
        out.append(rule)
        left = [i for i in left if i not in set(hit)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rules_equal_literal_covering(seed):
    """Two kinds of bad rows, each told by two conditions: the learned list has several rules with several conditions."""
    rng = random.Random(seed)
    rows = [{n: rng.randrange(20) / 2 for n in ("a", "b", "c")} for _ in range(400)]
    bad = [(r["a"] > 6 and r["b"] <= 4) or (r["c"] <= 2 and r["b"] > 6) for r in rows]
    prune = [rng.random() < 1 / 3 for _ in rows]
    got = quality_rules.learn_list({n: np.array([r[n] for r in rows]) for n in ("a", "b", "c")}, np.array(bad), np.array(prune))
    assert [[(c.feature, c.above, c.threshold) for c in r.conditions] for r in got] == literal_covering(rows, bad, prune)
    assert len(got) >= 2 and max(len(r.conditions) for r in got) >= 2


# --- 7. PPM


def test_ppm_is_a_distribution(spark):
    texts = ["abracadabra", "abra cadabra", "", None, "é"] * 3
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for nodes in (1 << 21, 20):
        scorer = ppm.fit(df.select(F.col("text").alias("own_text")), order=3, nodes=nodes).ready()
        for context in (b"", b"a", b"abr", b"xyz", b"zab", "é".encode()):
            base = 0
            for s in [ppm._PAD] * (3 - len(context[-3:])) + list(context[-3:]):
                base = (base << 9) | s
            grams = np.array([(base << 9) | s for s in range(257)], dtype=np.int64)
            assert abs(float((10 ** scorer.log10(grams)).sum()) - 1) < 1e-9


def test_ppm_scores(spark):
    texts = [prose(i, 30, 40) for i in range(40)] + [None, "", "ALL New Words", "A\x1cb c", "long " * 400_000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")])
    train = F.col("doc_id") % 5 != 0
    rows = df.collect()
    c = Counter()
    for r in rows:
        if r.doc_id % 5:
            c.update([w.encode().lower() for w in WORD.findall(r.text or "")] + [None])
    total = sum(c.values())
    log = lambda w: math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1)))
    for head in (1 << 20, 8):
        got = ppm.score(df, train, head=head).collect()
        assert len(got) == len(rows)
        for r in got:
            own = [w.encode().lower() for w in WORD.findall(texts[r.doc_id] or "")] + [None]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(own), sum(c[w] > 0 for w in own), total, r.doc_id % 5 > 0)
            assert abs(r.base_score - sum(map(log, own))) < 1e-6 * max(1, abs(r.base_score))
            assert r.score < 0
    assert got[0].score == pytest.approx(next(r.score for r in got[1:] if r.doc_id == 0)) if got[0].doc_id == 0 else True
    assert ppm.score(df.limit(0), train).count() == 0
    untrained = ppm.score(df.where("doc_id = 42"), F.lit(False)).first()
    assert untrained.train_tokens == 0 and untrained.score == pytest.approx(-14 * math.log10(257))


@pytest.mark.parametrize("nodes", [1 << 21, 200, 20])
def test_ppm_scores_are_of_the_whole_model(spark, nodes):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", f"x{rng.randrange(90)}", "é"]) for _ in range(20)) for _ in range(40)] + ["", "qqq alphx", "zz ab\x00 é9", "alpha"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    train = F.col("doc_id") % 4 != 1
    scorer = ppm.fit(df.where(train).select(F.col("text").alias("own_text"))).ready()  # nothing is rare enough to be pruned
    got = by(ppm.score(df, train, nodes=nodes), "doc_id")
    for i, t in enumerate(texts):
        symbols, _ = ppm._stream([t.encode()], 4)
        assert got[i]["score"] == pytest.approx(float(scorer.log10(ppm._grams(symbols, 4)).sum()), abs=1e-8), t


def literal_ppm(train, text, order=4):
    """log10 of a text's probability by prediction by partial matching, method C with exclusion, from plain tables."""
    end, pad = 256, 257
    after = {}
    for t in train:
        line = [pad] * order + list(t.encode()) + [end]
        for i in range(order, len(line)):
            for k in range(order + 1):
                after.setdefault(tuple(line[i - k : i]), Counter())[line[i]] += 1
    out, line = 0.0, [pad] * order + list(text.encode()) + [end]
    for i in range(order, len(line)):
        refused = set()
        for k in range(order, -1, -1):
            own = after.get(tuple(line[i - k : i]))
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in refused}
            new = 0 if len(own) == 257 else len(left)
            if line[i] in own:
                out += math.log10(own[line[i]] / (sum(left.values()) + new))
                break
            if left:
                out += math.log10(new / (sum(left.values()) + new))
            refused |= set(own)
        else:
            out -= math.log10(257 - len(refused))
    return out


@pytest.mark.parametrize("nodes", [1 << 21, 30])
def test_ppm_scores_equal_the_literal_model(spark, nodes):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", f"x{rng.randrange(90)}", "é"]) for _ in range(20)) for _ in range(40)] + ["", "qqq alphx", "zz ab\x00 é9", "alpha", "alpha"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = by(ppm.score(df, F.col("doc_id") % 4 != 1, nodes=nodes), "doc_id")
    train = [t for i, t in enumerate(texts) if i % 4 != 1]
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(literal_ppm(train, t), abs=1e-6), t


def test_ppm_learns(spark):
    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50))
    df = docs(spark, [(i, make(), "s") for i in range(50)] + [(99, "".join(rng.choices("qzxjkv", k=290)), "s")])
    got = by(ppm.score(df, F.col("doc_id") < 40), "doc_id")
    assert got[45]["score"] / len(df.where("doc_id = 45").first().text) > 3 * got[99]["score"] / 290
    assert abs(got[45]["score"] / math.log10(2)) < 50 * 2.5


# --- 8. WARC


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "é" * 50), (4, None, None), (5, "http://e", ""), (6, "http://f", "x" * 300_000), (6, "http://f", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, address string")
    for n, least in enumerate((0, 5)):
        path = f"file://{tmp_path}/{n}"
        warc_store.write_archive(df, path, min_bytes=least)
        got = warc_store.read_digests(spark, path).collect()
        assert len(got) == len(pages)
        assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in pages})
        for r in got:
            raw = (next(p[2] for p in pages if p[0] == r.record_id) or "").encode()
            first = max(p[0] for p in pages if (p[2] or "").encode() == raw)
            revisit = first != r.record_id and len(raw) >= least
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        for r in warc_store.read_records(spark, path).collect():
            head, _, body = bytes(r.record).partition(b"\r\n\r\n")
            raw = (next(p[2] for p in pages if p[0] == r.record_id) or "").encode()
            assert head.startswith(b"WARC/1.1\r\n") and bytes(r.payload) == raw
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert body[:length].partition(b"\r\n\r\n")[2] == (raw if r.record_type == "response" else b"") and body[length:] == b"\r\n\r\n"
    odd = [(1, "http://x/\r\nWARC-Payload-Digest: sha1:NO\x7f", "a"), (1, "http://y", "b"), (None, "http://z", "a"), (2, "http://w", "a"), (2, "http://w", "a")]
    path = f"file://{tmp_path}/odd"
    warc_store.write_archive(spark.createDataFrame(odd, "page_id long, url string, html string"), path)
    assert Counter((r.record_id, r.record_type, r.refers_to) for r in warc_store.read_digests(spark, path).collect()) == Counter([(1, "revisit", 2), (1, "response", None), (None, "revisit", 2), (2, "response", None), (2, "response", None)])
    heads = spark.read.parquet(f"{path}/headers").collect()
    assert {r.target for r in heads} == {x[1] for x in odd}
    field = lambda r, name: re.search(rf"\r\n{name}: ([^\r\n]*)", r.head)[1]
    assert len({field(r, "WARC-Record-ID") for r in heads}) == 4
    target = next(field(r, "WARC-Record-ID") for r in heads if r.record_id == 2)
    assert {field(r, "WARC-Refers-To") for r in heads if "revisit\r" in r.head} == {target}
    assert field(next(r for r in heads if r.target == odd[0][1]), "WARC-Target-URI") == "http://x/%0D%0AWARC-Payload-Digest: sha1:NO%7F"
    named = spark.createDataFrame([("a b&\n%", "u", "p"), ("é", "v", "p"), ("0", "w", "q")], "page_id string, url string, html string")
    warc_store.write_archive(named, f"file://{tmp_path}/named")
    assert {(r.record_id, r.refers_to) for r in warc_store.read_digests(spark, f"file://{tmp_path}/named").collect()} == {("a b&\n%", "é"), ("é", None), ("0", None)}
    warc_store.write_archive(df.limit(0), f"file://{tmp_path}/none")
    assert warc_store.read_digests(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc_store.write_archive(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    bad.cache().count()
    bad.write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not give its address"):
        warc_store.read_digests(spark, path).collect()


# --- 9. N-gram join


def jaccard_classes(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    links = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b), links[b].add(a)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("block", [128, 4])
def test_ngram_join(spark, block):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        words = prose(g, 120).split()
        for _ in range(rng.randrange(1, 12)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                own[rng.randrange(120)] = f"n{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(own)))
    for t in (None, "", " ", "a b", "a b", "a b c", "w " * 20_000, "w " * 30_000):
        rows.append((len(rows), t))
    df = docs(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_classes(df, block=block).collect()}
    assert got == jaccard_classes(rows)
    assert ngram_join.ngram_classes(df.limit(0)).count() == 0
    twice = ngram_join.ngram_classes(df.union(df)).collect()
    assert len(twice) == 2 * len(rows) and {r.doc_id: (r.class_id, r.n_links) for r in twice} == got


def test_ngram_join_of_chains_and_repeated_keys(spark):
    words = [f"c{i}" for i in range(3000)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 70])) for i in range(300)]  # each near its neighbours only
    rows += [(300 + i, " ".join([f"t{i % 40}", *words[:60]])) for i in range(60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_classes(docs(spark, [(i, t, "s") for i, t in rows]), block=4).collect()}
    assert got == jaccard_classes(rows)
    a, b, c = (prose(i, 60, 5000) for i in range(3))
    twice = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (4, c), (None, a)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_classes(docs(spark, [(i, t, "s") for i, t in twice])).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_ngram_join_recall_on_supplied_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_classes(rows).collect()}
    sets, holds = {}, {}
    for r in rows.collect():
        w = WORD.findall(r.text or "")
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r.doc_id]:
            holds.setdefault(g, []).append(r.doc_id)
    links = {i: set() for i in sets}
    for i, own in sets.items():
        shared = Counter(j for g in own for j in holds[g] if j > i)
        for j, k in shared.items():
            if k >= 0.8 * (len(own) + len(sets[j]) - k) - 1e-9:
                links[i].add(j), links[j].add(i)
    ends = sum(map(len, links.values()))
    assert ends > 100 and sum(n for _, n in got.values()) >= 0.999 * ends
    assert all(got[i][1] <= len(x) for i, x in links.items())


def test_bands():
    for t in (0.5, 0.8, 0.9):
        b, r = ngram_join.bands_for(t)
        assert 1 - (1 - t**r) ** b >= 0.999 and b * r <= 320


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# --- 10. Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        left = total - sum(capped.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return capped | out
        capped |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(8)
    rows = []
    for s, n in ((None, 40), ("a", 300), ("b", 20), ("B", 150), ("é", 80), ("empty", 2)):
        for _ in range(n):
            rows.append((len(rows), None if s == "empty" else prose(len(rows), int(rng.paretovariate(1.2) * 20) % 400), s))
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 60)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0

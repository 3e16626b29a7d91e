"""Resampling, chat formatting and ranked search against brute force, on awkward rows and on tables with hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import chat, lexical, resampling
from storyloom.llm.templates import Template, TemplateError, folded_all, parse
from storyloom.llm.textkernel import NOT_WORD, Words, parted

random.seed(11)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 5))) for _ in range(400)] + ["é", "日本", "x9", "naïve"]
DOC = "doc_id long, text string, row long, item int, score long, words long, place long, n int, able boolean"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(k, seed):
    r = random.Random(seed)
    return r.choice([" ", ", ", "\n"]).join(r.choice(WORDS[: 20 + 19 * (seed % 20)]) for _ in range(k))


def terms(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, 2, 3, 4, 5, True) for i, t in rows], DOC).repartition(5)


@pytest.fixture(scope="module")
def rows():
    copies = [(1000 + i, prose(40, 77)) for i in range(200)]  # a third of all rows are copies
    odd = [(1, None), (2, ""), (3, " \n.,!"), (4, "one"), (4, "one"), (None, prose(50, 5)), (None, prose(50, 5)), (5, prose(90_000, 9)), (6, "ÀÉ É À Å " * 30), (7, "\x00a\x00b\x7fc" * 9), (8, "UPPER upper Upper"), (9, "z" * 70000)]
    return odd + copies + [(20 + i, prose(random.Random(i).randint(1, 120), i)) for i in range(350)]


def test_parts_of_a_long_text_hold_its_words():
    text = prose(5000, 3) + " " + "y" * 9000 + " é" * 900
    b = pa.RecordBatch.from_pydict({"text": pa.array(["short one", text, None, text])})
    got = []
    for rb, parts in parted(iter([b]), "text", NOT_WORD, 1000):
        words = [[] for _ in range(rb.num_rows)]
        for t, _ in parts:
            w = Words(t, lower=True, gap=NOT_WORD)
            for i, d in enumerate(w.doc.tolist()):
                words[d].append(w.word(i).decode())
        got += words
    assert got == [["short", "one"], terms(text), [], terms(text)]


def drawn(rows, target, n, buckets, num, den, least):
    def features(x):
        w = terms(x)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * num // den]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, rows, n):
    target = [prose(60, 40), None, prose(60, 60), ""]
    got = resampling.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=500, num=30)
    plain = lambda rs: sorted((tuple(-(10**18) if x is None else x for x in r) for r in rs))
    assert plain(map(tuple, got.collect())) == plain(drawn(rows, target, n, 500, 30, 100, 20))


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert sorted(r["rank"] for r in resampling.resample(some, none, least_words=0, num=100).collect()) == [1, 2]
    assert [(r.n_features, r["rank"]) for r in resampling.resample(some, none).orderBy("doc_id").collect()] == [(2, None), (0, None)]


def test_payloads_of_joined_words():
    r = random.Random(4)
    for renewed in (1 << 20, 300):
        payloads = resampling.WordPayloads(most_bytes=renewed, longest=5)
        for k in range(12):
            texts = [prose(r.randint(0, 2000), 100 * k + i) for i in range(3)] + ["", "é" * 90]
            w = Words(pa.array(texts), lower=True, gap=NOT_WORD)
            crc, length = payloads(w)
            assert crc.tolist() == [zlib.crc32(x.encode()) for t in texts for x in terms(t)]
            assert length.tolist() == [len(x.encode()) for t in texts for x in terms(t)]
    a, b = [bytes(r.randrange(256) for _ in range(k)) for k in range(0, 400, 7)], [bytes(r.randrange(256) for _ in range(k % 301)) for k in range(0, 400, 7)]
    got = resampling.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def ranked(rows, items, k):
    tfs = [Counter(terms(t)) for _, t in rows]
    n_docs, n_words = sum(1 for c in tfs if c), sum(c.total() for c in tfs)
    df = Counter(w for c in tfs for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in asked.items():
        w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) for x in ws}
        scores = []
        for (d, _), c in zip(rows, tfs):
            m = 100 - 90 + (90 * c.total() * n_docs) // max(1, n_words)
            s = sum(w[x] * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in ws if x in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize(("k", "most_words", "most_sent"), [(10, 100_000, 500_000), (3, 60, 5)])
def test_search(spark, rows, k, most_words, most_sent):
    items = [(1, prose(30, 77)), (2, prose(25, 5)), (3, None), (4, ""), (5, "nowhere"), (6, "one É 日本"), (7, prose(40, 9)), (7, prose(12, 33)), (8, "z" * 70000 + " upper"), (None, prose(9, 12)), (9, prose(60, 19).upper())]
    got = lexical.search(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), k=k, most_words=most_words, most_sent=most_sent)
    plain = lambda rs: sorted(tuple(-1 if x is None else x for x in r) for r in rs)
    assert plain(map(tuple, got.collect())) == plain(ranked(rows, items, k))


def test_search_without_rows(spark):
    none, some = (spark.createDataFrame(x, "doc_id long, text string") for x in ([], [(1, "a b")]))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(some, items).collect()] == ([] if math.floor(1000 * math.log(4 / 3)) <= 0 else [(1, 1, 1)])


def test_bounds_hold_and_prune(rows):
    """No bound is below an exact score, and most are equal to it."""
    docs = [(t, Counter(terms(t))) for _, t in rows if terms(t)]
    texts = pa.array([t for t, _ in docs], pa.string())
    row, term, count, n = lexical._counted(iter([(texts, False)]), len(docs))
    q = lexical.Queries([(k, terms(prose(30, 50 + k))) for k in range(8)], 90)
    df = np.array([sum(w.decode() in c for _, c in docs) for w in q.vocabulary.words])
    q.with_figures(len(docs), int(n.sum()), df)
    blocks, made = lexical._Blocks(), []
    for i in range(len(docs)):
        here = row == i
        keys = np.concatenate([lexical._level_keys(term[here & (count >= s)], k) for k, s in enumerate(lexical.LEVELS)])
        made += blocks.add(i, i, int(n[i]), keys)
    made += blocks.rest()
    same = total = 0
    for slices, size, ids, _, _, ns, bits in made:
        top = q.bounds(slices, size, np.frombuffer(ns, "<i8"), np.frombuffer(bits, np.uint8))
        for j, i in enumerate(np.frombuffer(ids, "<i8").tolist()):
            c = docs[i][1]
            m = 100 - 90 + (90 * c.total() * len(docs)) // int(n.sum())
            for k in range(8):
                exact = sum(int(q.weight[t]) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for t in q.of[k] if (w := q.vocabulary.words[t].decode()) in c)
                assert top[k, j] >= exact
                same, total = same + (top[k, j] <= exact * 1.02), total + 1
    assert same > 0.5 * total


TALK = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|>\n</s>"), (1, 2, "user", None), (1, 3, "assistant", "\\ [INST] \\[INST] é\U0001f600"), (2, 5, "system", "s\r\n \x00"), (None, 1, "assistant", "a"), (None, None, "user", "b"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t"), (3, 1, None, ""), (4, 0, "as\nsi<s>st\\", "<|im_start|>user\nno"), (5, 0, "assistant", "w " * 300_000)]


def digests(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((-9 if c is None else c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


def test_chats_come_back(spark):
    hot = [(9, k, "user" if k % 2 else "assistant", f"turn {k} </s>") for k in range(500)] + [(9, -3, "system", "first")]
    rows = TALK + hot + [(100 + i, k, ("user", "assistant")[k % 2], prose(20, i + k)) for i in range(60) for k in range(i % 5)]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, slot int, spans string").repartition(6)
    for bits in (4, 12):
        lines = chat.format_chats(turns, slice_bits=bits)
        assert (lines.where("several").count() > 0) == (bits == 4) or bits == 12
        got = chat.chat_digests(lines).collect()
        assert sorted((-9 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == digests(rows)
        text = "".join(r.text for r in lines.where("conv_id = 1").orderBy("place").collect())
        assert text.startswith("<s>") and text.endswith("</s>") and text.count("<|im_end|>") == 4 and text.count("</s>") == 1
    assert chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0


def test_escapes_return():
    r = random.Random(8)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "/", "im_end", "\n", "x"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        for f in (chat.escape, chat.header):
            assert chat.unescape(f(x)) == x and not any(c in f(x) for c in chat.CONTROL)


def test_templates():
    t = Template("{# all #}[{% set who = 'bot' %}{% for m in messages %}{% if loop.first and m.role == 'system' %}S:{{ m['text'] | trim }};{% elif m.role == who %}{% generation %}{{ m.text }}{% if loop.last %}!{% endif %}{% endgeneration %}|{% else %}{{ loop.index }}={{ m.text | upper ~ ('?' if m.ask else '.') }}{% endif %}{% endfor %}]")
    talk = [{"role": "system", "text": " be "}, {"role": "user", "text": "a", "ask": 1}, {"role": "bot", "text": "b"}, {"role": "user", "text": "c"}, {"role": "bot", "text": "d"}]
    text, spans = t.render(talk)
    assert text == "[S:be;2=A?b|4=C.d!|]" and [text[a:b] for a, b in spans] == ["b", "d!"]
    assert "".join(t.turn({}, m, i, i == 4)[0] for i, m in enumerate(talk)) == text
    assert Template("a  {%- for m in messages -%}  {{- m.text -}}  {%- endfor %} z").render(talk)[0] == "a be abcd z"
    nodes = folded_all(parse("x{{ 1 + 2 }}{% if not true or 'a' == 'b' %}never{% elif 'é' | upper == 'É' %}{{ 'y' ~ none }}{% else %}z{% endif %}w{{ 'a' if false else 'b' }}"))
    assert [(n.kind, n.value) for n in nodes] == [("text", "x3ywb")]
    for bad in ("{% for m in messages %}", "{{ }}", "{{ a.b( }}", "{{ x | eval }}", "{{ x.__class__ }}", "{% import os %}", "{{ f(1) }}", "{% for m in messages %}{{ messages[0] }}{% endfor %}", "{{ messages }}", "plain", "{% if a %}{% for m in messages %}{% endfor %}{% endif %}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert Template("{% for m in messages %}{{ m.text.upper }}{{ m.role[0] }}{{ gone.deep }}{% endfor %}").render(talk[1:2])[0] == "u"

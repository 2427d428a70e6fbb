"""Decontamination, toxicity, pages, passages, token counts, pieces and the pipeline."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from spendframe.llm import decontam, pages, passages, pieces, queries, token_counts, toxicity

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def words_of(n, seed):
    rng = random.Random(seed)
    return [f"t{rng.randrange(5000)}" for _ in range(n)]


def brute_contained(docs, items):
    def runs(text):
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    return {(key, item) for key, text in docs for item, body in items if runs(body) and 5 * len(runs(body) & runs(text)) >= 4 * len(runs(body))}


def test_decontamination(spark, docs_of, odd_rows):
    items = [(i, " ".join(words_of(20 + i, i))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = list(odd_rows)
    for i in range(12):
        held = words_of(20 + i, i)
        if i % 3 == 1:
            held[0] = "changed"
        if i % 3 == 2:
            held[len(held) // 2 :] = words_of(10, 900 + i)
        docs.append((100 + i, " ".join(words_of(300, 500 + i) + held + words_of(300, 700 + i)).upper().replace(" ", ", ")))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contained(docs_of(docs), table).collect()}
    wanted = brute_contained(docs, items)
    assert found == wanted and wanted
    clean = decontam.clean(docs_of(docs), table)
    assert clean.dtypes == docs_of([]).dtypes
    leaked = {key for key, _ in wanted}
    assert clean.count() == sum(key not in leaked for key, _ in docs)
    assert decontam.clean(docs_of([]), table).count() == 0
    assert decontam.clean(docs_of(docs), table.limit(0)).count() == len(docs)


def test_segments_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.integers(-4, 5, rng.integers(1, 25)).astype(float)
        wanted, todo = [], [(0, len(scores))]
        while todo:  # the best segment (the shortest of equals), then what lies before and after it
            low, high = todo.pop()
            every = [(scores[a:b].sum(), a - b, a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
            if every and max(every)[0] > 0:
                total, _, a, b = max(every)
                wanted.append(total)
                todo += [(low, a), (b, high)]
        assert sorted(s for *_, s in toxicity.segments(scores)) == pytest.approx(sorted(wanted))


def test_toxicity_learns_and_leaves_held_out_alone(spark, docs_of, odd_rows):
    rng = random.Random(2)
    bad = ["vile", "rotten", "scum"]
    rows, labels = [], []
    for i in range(400):
        words = words_of(60, 1000 + i)
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(bad))
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(i % 4 == 0)))
    docs = docs_of(rows + odd_rows)
    model = toxicity.fit(docs, spark.createDataFrame([*labels[:300], (1, None), (None, 1)], "doc_id long, toxic int"))
    found = toxicity.judged(docs, model).collect()
    assert len(found) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    for row in found:
        toxic = any(w in bad for w in (row.text or "").split())
        assert row.predicted == int(toxic)
        assert not toxic or any(w in bad for p in row.passages for w in row.text[p.start : p.end].split())
    kept = toxicity.accepted(docs, model)
    assert kept.dtypes == docs.dtypes and kept.count() == 300 + len(odd_rows)
    assert toxicity.judged(docs_of([]), model).count() == 0
    assert toxicity.fit(docs_of([]), spark.createDataFrame([], "doc_id long, toxic int")).score([]) <= 0.5


def test_toxicity_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op5_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    seen = found[found.held_out].merge(labels, on="doc_id")
    caught = seen[(seen.toxic == 1) & (seen.predicted == 1)]
    assert len(caught) >= 0.85 * (seen.toxic == 1).sum()
    assert len(caught) >= 0.8 * (seen.predicted == 1).sum()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="post-12 entry"><h2>Title &amp; more</h2><p>First <b>bold
 text</b> &#233;&nbsp;here<p>Second<br>line <a href="x">with link</a> and enough words to count as text.
<script>var t = "</div>";</script><div class="ad-box">Buy now</div><form>Name <input></form><!-- gone -->
<ul><li>One<li>Two</ul><aside>Beside</aside><div id="comments"><p>Reader says</p></div></div>
<div class="cookie notice">Cookies</div><footer>Foot</footer></body></html>"""
TEXT = "Title & more\nFirst bold text é here\nSecond line with link and enough words to count as text.\nOne\nTwo"


def test_pages(spark):
    other = PAGE.replace("post-12", "post-34")
    odd = PAGE.replace('<div class="post-12 entry">', "").replace("</div></div>", "</div>")
    rows = [(i, "http://a.example/x", PAGE if i % 2 else other) for i in range(6)]
    rows += [(6, "http://A.example/odd", odd), (7, None, None), (8, "no host", ""), (9, "http://b.example", "<div>only"), (10, "http://b.example", "plain &am"), (11, "x", "<")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in pages.extract(frame).collect()}
    assert len(found) == len(rows)
    assert all(found[i].text == TEXT and found[i].n_chars == len(TEXT) for i in range(7))
    assert [found[i].text for i in (7, 8, 9, 10, 11)] == ["", "", "only", "plain &am", "<"]
    assert pages.extract(frame.limit(0)).count() == 0
    assert pages.host_paths(frame).filter("_host = 'a.example'").first()["_path"] == "/html/body.has-sidebar/div.entry.post-0"


def test_passages(docs_of, odd_rows):
    shared, close = words_of(60, 1), words_of(200, 2)
    changed = list(close)
    changed[100] = "other"
    rows = [(i, " ".join(words_of(150, 10 + i) + shared + words_of(90, 90 + i))) for i in range(20, 32)]
    rows += [(40, " ".join(words_of(50, 5) + close)), (41, " ".join(words_of(70, 6) + changed))]
    rows += [(50 + i, " ".join(words_of(100, 300 + i) + "the same few words of one short line here".split())) for i in range(30)]
    found = passages.find(docs_of(rows)).collect()
    met = {frozenset((r.doc_id, r.lead_doc_id)) for r in found}
    joined = set().union(*met)
    assert set(range(20, 32)) <= joined and frozenset((40, 41)) in met and not joined & set(range(50, 80))
    texts = dict(rows)
    for r in found:
        part = texts[r.doc_id].split()[r.start : r.end]
        lead = texts[r.lead_doc_id].split()[r.lead_start : r.lead_end]
        assert r.n_words == len(part) >= 50 and r.similarity >= 0.8
        assert len({*zip(part, part[1:])} & {*zip(lead, lead[1:])}) > 30
    assert passages.find(docs_of(odd_rows)).filter("doc_id = 9 OR lead_doc_id = 9").count() >= 1
    assert passages.find(docs_of([])).count() == 0


def hashed(words):
    return passages.shingles(" ".join(words), passages.WordHashes())


def has_alike(a, b, least=46, similarity=0.8):
    """Whether stretches of ``least`` shingles or more, at any places, are alike: by brute force over sets."""
    for size in range(least, min(len(a), len(b)) + 1):
        for i in range(len(a) - size + 1):
            one = set(a[i : i + size].tolist())
            for j in range(len(b) - size + 1):
                two = set(b[j : j + size].tolist())
                if len(one & two) >= similarity * len(one | two):
                    return True
    return False


@pytest.mark.parametrize("size", [50, 55, 60, 65, 70])
def test_short_near_passages_with_an_edit_at_each_place(size):
    for at in range(size):
        base = [f"p{i}" for i in range(size)]
        changed = [*base[:at], "other", *base[at + 1 :]]
        a = hashed([f"a{i}" for i in range(8)] + base + [f"b{i}" for i in range(9)])
        b = hashed([f"c{i}" for i in range(11)] + changed + [f"d{i}" for i in range(7)])
        found = passages.repeats(a, b, 46, 0.8)
        assert bool(found) == has_alike(a, b), (size, at)
        for start, end, low, high, share in found:
            one, two = set(a[start:end].tolist()), set(b[low:high].tolist())
            assert share == len(one & two) / len(one | two) >= 0.8 and end - start >= 46 <= high - low


def test_exact_passage_beside_another_passage():
    near, exact = [f"n{i}" for i in range(200)], [f"e{i}" for i in range(50)]
    a = hashed(near + [f"a{i}" for i in range(300)] + exact[:20] + exact)
    b = hashed([*near[:100], "other", *near[101:]] + [f"b{i}" for i in range(300)] + exact[30:] + [f"c{i}" for i in range(40)] + exact)
    found = passages.repeats(a, b, 46, 0.8)
    assert any(s <= 0 and e >= 196 for s, e, *_ in found)
    assert any(s <= len(a) - 46 and e == len(a) and c <= len(b) - 46 and d == len(b) for s, e, c, d, _ in found)


def test_exact_passage_between_pieces_in_another_order():
    near, exact = [f"n{i}" for i in range(200)], [f"e{i}" for i in range(50)]
    pieces_of = [[f"x{k}y{i}" for i in range(30)] for k in range(10)]
    a = near + [f"a{i}" for i in range(300)] + sum(pieces_of[:5], []) + exact + sum(pieces_of[5:], [])
    b = [*near[:100], "other", *near[101:]] + [f"b{i}" for i in range(300)] + pieces_of[3] + exact + pieces_of[7]
    for k in (0, 1, 2, 4, 5, 6, 8, 9):
        b += [f"c{k}d{i}" for i in range(150)] + pieces_of[k]
    s, c = a.index("e0"), b.index("e0")
    found = passages.repeats(hashed(a), hashed(b), 46, 0.8)
    assert any(x <= s and s + 46 <= e and y <= c and c + 46 <= z for x, e, y, z, _ in found)


def test_a_text_is_done_only_where_its_passage_is(docs_of):
    rows, wanted = [], set()
    for k in range(40):
        one, two = ([f"{name}{k}x{i}" for i in range(60)] for name in "pq")
        fill = [[f"{name}{k}x{i}" for i in range(90)] for name in "abcd"]
        rows += [
            (10 * k, " ".join(fill[0] + one + fill[1] + two[:40])),
            (10 * k + 1, " ".join(one + fill[2] + two)),
            (10 * k + 2, " ".join(fill[3] + two)),
        ]
        wanted |= {frozenset((10 * k, 10 * k + 1)), frozenset((10 * k + 1, 10 * k + 2))}
    found = passages.find(docs_of(rows)).collect()
    assert {frozenset((r.doc_id, r.lead_doc_id)) for r in found} == wanted


def test_windows_cover_every_stretch_once():
    rng = np.random.default_rng(4)
    values = rng.permutation(200).astype(np.uint64)
    windows = passages.compact_windows(values, 20)
    for start in range(0, 181, 7):
        for end in range(start + 20, 201, 11):
            least = start + int(values[start:end].argmin())
            assert sum(a <= start and end - 1 <= b and c == least for a, c, b in windows) == 1


def test_rollups(spark, tmp_path):
    rows = [("a", "en", "v1", 5, 50), ("a", "en", "v1", 7, 70), (None, None, "v1", None, 3)]
    table = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long, bytes long")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    rollup.commit("1", token_counts.signed(table, 1))
    rollup.commit("2", token_counts.signed(table.filter("tokens = 5"), -1))
    new = spark.createDataFrame([("a", "en", "v2", 9, 70)], table.schema)
    for _ in range(3):
        rollup.commit("3", token_counts.signed(table.filter("tokens = 7"), -1).unionByName(token_counts.signed(new, 1)))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v2", 1, 9, 70), (None, None, "v1", 1, 0, 3)}
    rollup.commit("4", token_counts.signed(table.limit(0), 1))
    assert rollup.totals().count() == 2


def test_token_count_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    quality = dict(zip(labels.doc_id, labels.quality, strict=True))
    encoders = [token_counts.tokenizer(open(public_tokenizers.path(f"{n}.tiktoken"), "rb").read(), public_tokenizers.PATTERN) for n in queries.TOKENIZERS]
    wanted = {}
    for row in docs.itertuples():
        mark = quality.get(row.doc_id)
        if mark == 0:
            continue
        text = re.sub(r"[\x20\x09-\x0D]+", " ", row.text) if mark == 1 else row.text
        key = row.source, row.lang, queries.TOKENIZERS[int(mark == 1)]
        old = wanted.get(key, (0, 0, 0))
        wanted[key] = (old[0] + 1, old[1] + len(encoders[int(mark == 1)].encode_ordinary(text)), old[2] + len(text.encode()))
    found = {(r.source, r.lang, r.tokenizer): (r.n_documents, r.n_tokens, r.n_bytes) for r in queries.op8_token_counts(spark, SMALL).collect()}
    assert found == wanted


MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "  two  spaces ", "Plain words here", "tab\tand\nline", "ünïcödé ▁ mark", "\U0001f600 emoji \U0001f468‍\U0001f469", "a\0b", "</s> <unk> <0x41>", "x" * 5000, "日本語テキスト"]


def test_pieces_and_their_spans():
    own = pieces.Encoder(MODEL)
    for text in TEXTS:
        ids = own.ids(text)
        starts, ends = own.spans(text, ids)
        data = text.encode()
        assert ids == own.library.encode(text)
        assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
        for i, a, b in zip(ids, starts, ends, strict=True):
            if not own.library.is_byte(i):
                assert data[a:b].decode().replace(" ", "▁") in own.library.id_to_piece(i)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_matches_the_library(rule):
    """The compiled map of public rules, through a model that holds it."""
    spec = pieces.sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(MODEL)
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    rules = pieces.sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(library.serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = True
    own = pieces.Encoder(spec.SerializeToString())
    own.plain = False
    for text in [*TEXTS, "ﬁne Ⅳ ｆｕｌｌ　width ① é", "  a  b  "]:
        body, origin = own.normalise(text)
        assert body.decode() == own.library.normalize(text)
        assert len(origin) == len(body) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())


def test_encoded_rows(docs_of, odd_rows):
    own = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    found = pieces.encode(docs_of(odd_rows), MODEL).collect()
    assert len(found) == len(odd_rows)
    for row in found:
        assert row.ids == [*own.encode(row.text or ""), own.eos_id()]
        assert own.decode(row.ids) == (row.text or "")
        assert row.ends[-1] == len((row.text or "").encode())
    digests = pieces.encode(docs_of(odd_rows), MODEL, digests=True).collect()
    assert {(r.doc_id, r.n_tokens) for r in digests} == {(r.doc_id, len(r.ids)) for r in found}
    assert pieces.encode(docs_of([]), MODEL).count() == 0


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, LARGER).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] < sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert last.count() == sizes[-1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, LARGER).select("doc_id").collect()} == {r.doc_id for r in last.select("doc_id").collect()}


def test_token_counts_of_many_texts_wait_in_bounded_lists(monkeypatch):
    monkeypatch.setattr(toxicity, "PENDING_TOKENS", 50)
    counts, texts = toxicity.Counts(), [np.array([k % 7, 3, 3, 1 << 19], dtype=np.int64) for k in range(100)]
    for k, found in enumerate([*texts, np.zeros(0, dtype=np.int64)]):
        counts.add(k % 2, found)
        assert counts.pending < 50
    rows = [row for batch in counts.rows() for row in batch.to_pylist()]
    for kind in (0, 1):
        tokens, once = Counter(), Counter()
        for found in texts[kind::2]:
            tokens.update(found.tolist())
            once.update(set(found.tolist()))
        assert {r["bucket"]: (r["n"], r["m"]) for r in rows if r["kind"] == kind} == {b: (n, once[b]) for b, n in tokens.items()}


def test_passages_of_many_texts_are_made_in_few_steps_and_as_of_each_alone(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["", "one two", *(" ".join(f"w{n}" for n in rng.integers(0, 90, size)) for size in rng.integers(1, 400, 60))]
    calls, mixed = [], passages.mixed
    monkeypatch.setattr(passages, "mixed", lambda values, seed: calls.append(seed) or mixed(values, seed))
    own, starts = passages.joined_shingles(texts, passages.WordHashes())
    table, values = passages.all_windows(own, starts, 3, 46)
    rows, minima = passages.all_minima(own, starts, 3, 46)
    at, keys, low, high = passages.cell_keys(own, starts, table, 46)
    assert len(calls) < 40
    parts = np.split(own, starts[1:-1])
    for place, (text, part) in enumerate(zip(texts, parts, strict=True)):
        assert (passages.shingles(text, passages.WordHashes()) == part).all()
        edges = np.array([0, len(part)])
        alone, lows = passages.all_windows(part, edges, 3, 46)
        here = (table[:, 2] >= starts[place]) & (table[:, 2] < starts[place + 1])
        assert (table[here][:, 1:] - starts[place] == alone[:, 1:]).all() and (values[here] == lows).all()
        assert (minima[rows == place] == np.unique(lows)).all()
        _, *one = passages.cell_keys(part, edges, alone, 46)
        assert all((x[at == place] == y).all() for x, y in zip((keys, low, high), one, strict=True))
    assert list(passages.chunks(["a" * 9, "b", "c" * 30, "d"], 10)) == [(0, 2), (2, 3), (3, 4)]

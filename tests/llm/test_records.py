"""Preference pairs, mixing, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from breachlens.llm import mixing, warc
from breachlens.llm.preference import END, START, mismatched_answers, preference_pairs

TURNS = "pair_id long, side string, turn long, role string, text string, prompt string"


def brute_pair(chosen, rejected):
    say = lambda turns: "".join(f"{START}{r}\n{t}{END}\n" for r, t in turns)
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, say(chosen[:n])]
    for turns in (chosen[n:], rejected[n:]):
        spans, at = [], 0
        for r, t in turns:
            begin = at + len(START) + len(r) + 1
            if r == "assistant":
                spans.append(f"{begin}-{begin + len(t) + len(END)}")
            at += len(f"{START}{r}\n{t}{END}\n")
        out += [say(turns), ",".join(spans)]
    return tuple(out)


def test_pairs(spark):
    a, b, c, d = ("user", "hi é\U0001F600"), ("assistant", "hello"), ("assistant", "go away"), ("user", "why")
    pairs = {1: ([a, b], [a, c]), 2: ([a, b, d, b], [a, b, d, c, d]), 3: ([a], [a]), 4: ([b], [c]), 5: ([a, b], []), 6: ([], [a]), 7: ([a, b], [a]), 8: ([a, ("", "")], [a, b])}
    rows = [(p, side, t, r, x, "p") for p, both in pairs.items() for side, turns in zip(("chosen", "rejected"), both, strict=True) for t, (r, x) in enumerate(turns)]
    rows = [(p, s, t, r or None, x or None, q) for p, s, t, r, x, q in rows] + [(None, "chosen", 0, "user", "x", "p"), (1, "other", 0, "user", "x", "p")]
    found = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, TURNS).repartition(4)).collect()}
    assert found.keys() == pairs.keys()
    for p, (chosen, rejected) in pairs.items():
        r = found[p]
        assert (r.n_common, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == brute_pair(chosen, rejected)
        assert r.status == ("one_sided" if not chosen or not rejected else "identical" if chosen == rejected else "pair")
        for text, mask, learned in ((r.chosen, r.chosen_mask, r.chosen_learned), (r.rejected, r.rejected_mask, r.rejected_learned)):
            spans = [tuple(map(int, s.split("-"))) for s in mask.split(",") if s]
            assert all(text[x:y].endswith(END) for x, y in spans) and sum(y - x for x, y in spans) == learned


def test_repeated_turns_and_no_rows(spark):
    rows = [(1, s, t, r, x, "") for s in ("chosen", "rejected") for t, r, x in ((None, "user", "q"), (1, "user", "a"), (1, "assistant", "b"), (1, "user", "a"))]
    found = preference_pairs(spark.createDataFrame(rows, TURNS)).collect()
    assert [(r.n_common, r.n_chosen, r.status) for r in found] == [(4, 4, "identical")]
    assert preference_pairs(spark.createDataFrame([], TURNS)).count() == 0
    talks = spark.createDataFrame([(None, 0, "user", "x"), (3, None, None, None), (4, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert {r.pair_id: r.status for r in preference_pairs(mismatched_answers(talks)).collect()} == {3: "identical", 4: "one_sided"}


def brute_targets(sizes):
    """Shares by weight, the excess over twice a source's size reshared until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5000, "d": 3, None: 77}, {"x": 5}, {"x": 0, "y": 9}, {f"s{i:02}": 7 * i % 31 + 1 for i in range(40)}, {"": 1, None: 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r for r in mixing.source_targets(rows).collect()}
    wanted = brute_targets(sizes)
    assert found.keys() == wanted.keys()
    for s in wanted:
        assert found[s].target == pytest.approx(wanted[s], abs=1e-6) and found[s].rate <= 2


def test_mix(spark, messy, empty):
    found = mixing.mix(messy).collect()
    assert len(found) == messy.count() and all(0 <= r.taken <= 2 * r.size for r in found)
    again = mixing.mix(messy.repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    docs = mixing.mixed_documents(messy)
    assert docs.columns == messy.columns and docs.count() == sum(r.copies for r in found)
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', int(id % 50)) as text", "concat('s', if(id % 3 = 0, 0, id % 7)) as source")
    taken = mixing.mix(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(taken) == 7
    for r in taken:
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_mix_without_broadcast(messy, monkeypatch):
    wanted = sorted(map(tuple, mixing.mix(messy).collect()), key=repr)
    monkeypatch.setattr(mixing, "fits_broadcast", lambda table: False)
    assert sorted(map(tuple, mixing.mix(messy).collect()), key=repr) == wanted


PAGES = [
    (1, "http://a/x y\r\n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    (5, "http://d", "\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "http://e", "<p>é</p>"), (7, "http://f", "x" * 3_000_000), (-8, "http://g", "\x00\U0001F600"),
]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives_come_back(spark, folder, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame([(*p, "record") for p in PAGES], "page_id long, url string, html string, record string").repartition(3)
    found = warc.archived(pages, f"file://{folder}/warc").collect()
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    wanted = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        response = max(x for x in groups[html or ""] if x is not None)
        kind = ("response", None) if i == response else ("revisit", response)
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(wanted, key=repr)
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == {(h or "").encode() for _, _, h in PAGES}
    # Every place of the index is a whole gzip member by itself, and the members in a row are the archive.
    index = warc.read_index(spark, f"file://{folder}/warc/archives").orderBy("archive", "offset").collect()
    assert len(index) == len(PAGES)
    for row in index:
        with open(row.archive, "rb") as archive:
            archive.seek(row.offset)
            assert gzip.decompress(archive.read(row.length)).startswith(b"WARC/1.1\r\n")
    assert warc.archived(pages.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.archived(pages, min_payload=100).collect()}
    assert small[1] == small[2] == "response"


def test_normaliser_takes_streams_of_one_or_many_members():
    record = lambda n: f"WARC/1.1\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n".encode()
    sizes = [0, 5, 2_500_000, 1]
    for source in (gzip.compress(b"".join(map(record, sizes))), b"".join(gzip.compress(record(n)) for n in sizes)):
        out = io.BytesIO()
        index = warc.normalise(io.BytesIO(source), warc._Counted(out))
        data = out.getvalue()
        assert [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in index] == [record(n) for n in sizes]
        assert json.dumps(index)
    for broken in (gzip.compress(record(5))[:-12], gzip.compress(record(5)[:-6]), gzip.compress(b"nothing\r\n\r\n")):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(broken), warc._Counted(io.BytesIO()))


def test_stages_on_messy_and_no_rows(spark, messy, empty):
    for start in (messy, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, None)
            if name != "sentencepiece":
                assert docs.columns == start.columns
            assert docs.count() <= 2 * before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]


def test_pipeline_against_brute_force(spark):
    """Each stage by a plain loop over the same rows."""
    import public_tokenizers
    import sentencepiece

    from breachlens.llm import quality_rules

    from .test_duplicates import GAP, brute_components

    folder = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = [d for d in docs if quality_rules.verdict(t := (d["text"] or "").encode(), quality_rules.base_counts([t])[0], quality_rules.RULES) is None]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(GAP.sub(" ", d["text"] or ""), d)
    docs = list(first.values())
    component, _ = brute_components([(d["doc_id"], d["text"]) for d in docs], 5)
    docs = [d for d in docs if component[d["doc_id"]] == d["doc_id"]]
    words = {}
    for d in docs:
        words[d["source"]] = words.get(d["source"], 0) + len((d["text"] or "").split())
    targets, wanted = brute_targets(words), []
    spm = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d in docs:
        rate = targets[d["source"]] / words[d["source"]]
        place = int(hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        ids = spm.encode(d["text"] or "", add_bos=True, add_eos=True)
        wanted += [(d["doc_id"], d["text"], tuple(ids))] * (int(rate) + (place < rate - int(rate)))
    found = [(r.doc_id, r.text, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(found) == sorted(wanted)

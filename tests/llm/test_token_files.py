"""Round trips through the files, random access, damage, and ids against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slidelake.llm.token_files import CorruptFrame, Encoder, FrameReader, FrameWriter, opened, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


PARTS = ["the", " ", "  ", "\n", " \n", "\n\n", ".", ",", "it's", "Été", "naïve", "日本語", "\t", " ", "　", "<|endoftext|>", "12a", "!!", "'ll", "\x1c", "|", "a.\nB", "é", "ß", "\r\n", "🙂", "_", "-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert Encoder.of(PATH).encode(text).tolist() == plain(text)


def test_ids_on_the_table(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert Encoder.of(PATH).encode(r.text).tolist() == plain(r.text)


def test_round_trip_and_ranges(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 50)) for i in range(500)] + [(None, "no id"), (None, None), (7, "again"), (7, "again"), (9, ""), (600, "word " * 60_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, start int").repartition(5)
    files = write_token_files(df, f"file://{tmp_path}/out", PATH)
    assert files.agg({"n_docs": "sum"}).first()[0] == len(rows)
    got = sorted(read_token_files(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in sorted(got, key=lambda r: key((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())))] == sorted(
        ((d, [*plain(t), 2]) for d, t in rows), key=key
    )
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    some = read_token_files(spark, f"file://{tmp_path}/out", {7, 499, 10_000}).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 7, 499]


def test_empty(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", PATH)
    assert read_token_files(spark, f"{tmp_path}/none").collect() == []


def test_frames_are_read_alone_and_checked(tmp_path):
    fs, top = opened(str(tmp_path))
    with fs.open_output_stream(f"{top}/a.zst", compression=None) as f:
        writer = FrameWriter(f, 1)
        for i in range(200):
            writer.add(i, np.arange(i, i + 3000, dtype="<u4"))
        writer.close()
    whole = (tmp_path / "a.zst").read_bytes()
    # Any zstandard reader gets the frames and passes over the tables.
    reader = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    assert len(reader.read()) == sum(x[1] for x in FrameReader(fs.open_input_file(f"{top}/a.zst")).table)
    with fs.open_input_file(f"{top}/a.zst") as source:
        r = FrameReader(source)
        assert len(r.frames({150})) == 1 < len(r.table)
        ((doc, start, ids),) = r.documents({150})
        assert (doc, start) == (150, 150 * 3000) and np.frombuffer(ids, "<u4")[0] == 150
        at = r.offsets[r.frames({150})[0]]
    (tmp_path / "b.zst").write_bytes(whole[: at + 40] + bytes([whole[at + 40] ^ 1]) + whole[at + 41 :])
    with fs.open_input_file(f"{top}/b.zst") as source:
        r = FrameReader(source)
        assert [d for d, _, _ in r.documents({3})] == [3]
        with pytest.raises(CorruptFrame):
            list(r.documents({150}))

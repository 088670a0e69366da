from quillstone.functions.text import CJK
from quillstone.sources.checkpoints import write_checkpoint
from quillstone.streaming.checkpoints import stream_bigrams, stream_pages


def test_pages_arrive_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    page = lambda t: {"result": {"layoutParsingResults": [{"markdown": {"text": t}}]}}
    write_checkpoint(str(source / "chunk_0_1.pdf.json"), page("甲乙"))
    query = stream_bigrams(stream_pages(spark, str(source)), CJK).writeStream.outputMode("complete").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    write_checkpoint(str(source / "chunk_1_2.pdf.json"), page("甲乙丙"))
    query.processAllAvailable()
    query.stop()
    assert {r.bigram: r.n for r in spark.table("pairs").collect()} == {"甲乙": 2, "乙丙": 1}

import __spark_entry__ as e

ITEM = "Suppose a weaver borrows the skip table of shard 4027 while a damp barrel holds a bitmap with 1183 set bits. Given a trie over 68 paths and 5093 rotated offsets, which locket does the glazier open first?"
ZH = "园丁把霜白的灯笼当作6536个路径，并在第624次扫描之后归还内层的纱锭。钟表匠把霜白的梯子当作2069个路径，并在第821次回放之后称量左侧的铰链。"


def test_p9_stretches(spark, tmp_path):
    prompt = "Answer the question below."
    spark.createDataFrame([(1, "a", f"{prompt} {ITEM}"), (2, "a", f"{prompt} Other words of an item that nobody ever put into any text of this table, and yet it goes on for a while."), (3, "b", ZH)], "item_id bigint, suite string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    words = ITEM.split()
    changed = [*words[:9], "tarnished", *words[10:]]
    texts = {
        1: f"Seen:\n> {' '.join(words[:12])}\n> {' '.join(words[12:]).upper()}",  # quoted, broken, upper case
        2: " ".join(words[:19]),  # too short
        3: f"{' '.join(changed[:21])} and more",  # one changed word
        4: f"{' '.join([*words[:4], 'x', *words[5:9], 'y', *words[10:16], 'z', *words[17:22]])} end",  # changed too close to each other
        5: f"{prompt} {prompt}",
        6: f"前言 {ZH[5:55]} 结尾",
        7: " ".join(["**Suppose**", *words[1:9], *words[10:24]]),  # mark-up, one missing word
    }
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in e.queries()["p9_found"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (3, 1), (6, 3), (7, 1)}

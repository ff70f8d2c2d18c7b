"""Copies of benchmark items that were edited, or that stand beside another variant of their template."""

from reelstack.llm.decontaminate import decontaminate

ITEM = "Yesterday the baker Anna sold 12 kg of dark bread to Peter and then Anna gave 5 euros back to her old friend."
PLAIN = "filler words stand here before it all. "
OTHER = ITEM.replace("Anna", "Maria").replace("12", "40").replace("Peter", "Hugo")


def found(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    return {r["doc_id"]: (r["items"], r["reparameterised"]) for r in decontaminate(docs, bench, **settings).collect()}


def test_verbatim_copy_with_one_slot_changed(spark):
    texts = [PLAIN + ITEM.replace("Anna sold", "Maria sold"), PLAIN + ITEM.replace("then Anna", "then Maria") + PLAIN, PLAIN * 3]
    assert found(spark, texts, edited=True) == {0: ([7], True), 1: ([7], True), 2: ([], False)}


def test_two_variants_in_one_document(spark):
    # each lacks some windows, which the other has with other values
    half, rest = ITEM.replace("then Anna gave", "gave"), OTHER.replace("Yesterday the baker", "Once our baker")
    texts = [half + " " + PLAIN * 8 + rest, rest + " " + PLAIN * 8 + half]
    assert {i: x[0] for i, x in found(spark, texts).items()} == {0: [7], 1: [7]}

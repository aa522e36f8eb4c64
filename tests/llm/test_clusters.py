"""Members of a large cluster move once, whatever the number of its blocks."""

import random

from corpusjobs.llm import jaccard


def stages(spark) -> dict[int, int]:
    """Bytes that each stage so far has written for exchanges."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {own.apply(k).stageId(): own.apply(k).shuffleWriteBytes() for k in range(own.size())}


def test_members_move_once(spark):
    pick = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if pick.random() > 0.005 else f"x{pick.random()}" for w in base) for _ in range(96)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rule = jaccard.Rule(3, 80, 100)
    own = jaccard.classes(docs, rule).cache()
    own.count()
    sizes = []
    for block in (200, 4):
        before = stages(spark)
        assert jaccard.links(docs, own, rule, block=block).count() > 70
        sizes.append(sum(n for k, n in stages(spark).items() if k not in before))
    assert sizes[1] < 2 * sizes[0]

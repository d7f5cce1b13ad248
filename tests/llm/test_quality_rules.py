"""A group's own fence for repetition decides under the cutoff of the base rule."""
from veracell.llm import quality_rules


def words(seed, n):
    return [f"w{seed}x{i}" for i in range(n)]


def test_own_fence_decides_on_repeats(spark):
    plain = [(i, " ".join(words(i, 100)), "en", "a") for i in range(40)]
    often = [(100 + i, " ".join(words(i, 76) + 2 * words(100 + i, 12)), "en", "b")
             for i in range(40)]
    odd = (99, " ".join(words(98, 76) + 2 * words(99, 12)), "en", "a")
    df = spark.createDataFrame(plain + often + [odd],
                               "doc_id long, text string, lang string, source string")
    r = {x.doc_id: x for x in quality_rules.judge(df, min_group=20).collect()}
    assert r[99].n_repeat_words == 24 and not r[99].base_failed
    assert r[99].reasons == "repeat_share" and not r[99].kept
    assert all(x.kept for d, x in r.items() if d != 99)

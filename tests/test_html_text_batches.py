"""A task's Python holds few pages at a time, whatever the session's Arrow batches."""

from pyspark.sql import functions as F

from jobsift.functions.html import html_text_column, page_text


def test_html_text_takes_rows_in_small_batches(spark):
    pages = spark.range(0, 2000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(
        F.lit("&lt;p&gt;a &amp;amp; "), "id", F.lit("&lt;/p&gt;<script>x</script> é "))).alias("html"))
    out = pages.select("html", html_text_column()("html").alias("text"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in out.collect()] == [page_text(r.html) for r in pages.collect()]

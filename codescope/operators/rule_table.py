"""Rules kept in a table: thousands of patterns over lines without meeting every line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.operators.relational import _pieces
from codescope.session import cut_and_count, cut_lineage, lookup_side

PIECE = 4


def rule_table_scan(lines: DataFrame, rules: DataFrame, piece: int = PIECE) -> DataFrame:
    """(rule, project, path, line_no) once for each line that a rule matches.

    ``rules`` has rule, literal (a text every match contains) and regex; ``lines`` as in
    ``explode_lines``. A literal is proposed by its piece that is the rarest in the lines, of
    ``piece`` letters or of its whole length if it is shorter; then the literal and the regex
    are tested. Pieces no literal asks for are dropped where the lines are read, before anything
    is shuffled. Rules without a literal would meet every line and raise a ValueError; rules with
    a null regex, and null texts, match nothing. Rules of one name count as one.
    """
    kept, without = cut_and_count(rules.select("rule", "literal", "regex").distinct(), "literal IS NULL OR literal = ''")
    if without:
        raise ValueError(f"{without} rules without a literal")
    size = F.least(F.char_length("literal"), F.lit(piece))
    kept = kept.where("regex IS NOT NULL").withColumn("_size", size)
    sizes = [r["_size"] for r in kept.select("_size").distinct().collect()]  # at most ``piece`` numbers
    if not sizes:
        return lines.select(F.lit(None).cast("string").alias("rule"), "project", "path", "line_no").limit(0)
    asked = [kept.where(F.col("_size") == n).select("rule", "literal", "regex", F.explode(_pieces(F.col("literal"), n)).alias("gram")) for n in sizes]
    pieces = asked[0]
    for more in asked[1:]:
        pieces = pieces.unionByName(more)
    pieces = cut_lineage(pieces)
    grams, n_grams = cut_and_count(pieces.select("gram").distinct())
    texts = lines.where("text IS NOT NULL")

    def laid(wanted: DataFrame, n: int, *columns: str) -> DataFrame:
        """The lines' pieces, each with what is wanted of it."""
        parts = F.concat(*[_pieces(F.col("text"), n) for n in sizes])
        return texts.select(*columns, F.explode(parts).alias("gram")).join(lookup_side(wanted, n), "gram")

    frequency = laid(grams, n_grams).groupBy("gram").agg(F.count("*").alias("n"))
    counted = pieces.join(frequency, "gram", "left")
    rarest = counted.groupBy("rule", "literal", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_g"))
    index = rarest.where("_g.n > 0").select("rule", "literal", "regex", F.col("_g.gram").alias("gram"))
    index, n_index = cut_and_count(index)
    # A line's text stays with it: proposals of a line are tested where the line is read.
    proposed = laid(index, n_index, "project", "path", "line_no", "text")
    hits = proposed.where(F.contains("text", "literal")).where(F.rlike("text", F.col("regex")))
    return hits.select("rule", "project", "path", "line_no").distinct()

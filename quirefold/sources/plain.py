"""Plain text and Markdown: one prose block per section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.sources.parsed import block, failed, result


def sections(text: Column) -> Column:
    """Blocks of a text whose lines starting with "#" are headings.

    The text is cut in front of every heading line. A piece that is only a heading line
    yields no block; a piece with any further line does, even when those lines are blank.
    """

    def to_block(piece: Column) -> Column:
        titled = piece.startswith("#")
        cut = F.call_function("instr", piece, F.lit("\n"))
        head = F.substring_index(piece, "\n", 1)
        body = F.when(titled, F.when(cut > 0, F.substring(piece, cut + 1, F.length(piece)))).otherwise(piece)
        return block(tx.strip(body), "prose", heading=F.when(titled, tx.strip(F.regexp_replace(head, "^#+", ""))))

    lined = F.array_join(tx.text_lines(tx.strip(text)), "\n")
    pieces = F.filter(F.split(lined, "\n(?=#)"), lambda p: p != "")
    found = F.filter(F.transform(pieces, to_block), lambda b: b["text"].isNotNull())
    return tx.let(found, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(block(tx.strip(text), "prose"))))


def parse_text(text: Column) -> Column:
    return F.when(tx.strip(text) == "", failed(fv.EMPTY_FILE)).otherwise(result(sections(text)))

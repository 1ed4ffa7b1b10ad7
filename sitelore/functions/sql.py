"""Page-to-chunk work as SQL functions of a session, for jobs written in SQL.

    SELECT d.doc_id, p.* FROM pages d, LATERAL page_pieces(d.title, d.text) p

They are SQL table functions, so a query that calls them is planned as a whole.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sitelore import fixed
from sitelore.functions.text import SPACES



def _clean(x: str) -> str:
    """SQL of `clean_text`; a raw literal keeps the pattern's backslashes."""
    return f"trim(regexp_replace(coalesce({x}, ''), r'{SPACES}', ' '))"


def register_chunk_functions(
    spark: SparkSession,
    size: int = fixed.MAX_CHUNK_WORDS, overlap: int = fixed.OVERLAP_WORDS, minimum: int = fixed.MIN_CHUNK_WORDS,
) -> None:
    """Define, for this session:

    `text_windows(text)`: piece, words, text of the overlapping word windows of a text (none under
    `minimum` words); `page_pieces(title, text)`: type_ord, chunk_type, heading, piece, text of a page
    with a title and a plain text, its summary and its paragraphs.

    Each is one generator over an expression of its arguments: a lateral call is then made row by row.
    Nested laterals would be joined to the calling rows by their whole texts.
    """
    step = max(1, size - overlap)

    def windows(text: str, fields: str) -> str:
        """SQL array of structs for the windows of `text`: `fields`, of a number `i` and the `words` of the window."""
        return f"""flatten(transform(array(split({_clean(text)}, ' ')), w -> transform(
            transform(
              CASE WHEN size(w) < {minimum} THEN cast(array() AS array<int>)
                ELSE sequence(0, greatest(0, CAST(ceil((size(w) - {size}) / {step}) AS INT))) END,
              i -> named_struct('i', i, 'words', slice(w, i * {step} + 1, {size}))),
            p -> named_struct({fields}))))"""

    window = "'piece', p.i, 'words', size(p.words), 'text', array_join(p.words, ' ')"
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION text_windows(body STRING)
        RETURNS TABLE (piece INT, words INT, text STRING)
        RETURN SELECT x.piece, x.words, x.text FROM (SELECT inline({windows('body', window)})) x
        """
    )
    piece = "'type_ord', k.type_ord, 'chunk_type', k.chunk_type, 'heading', k.heading, 'piece', p.i, 'text', array_join(p.words, ' ')"
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION page_pieces(title STRING, body STRING)
        RETURNS TABLE (type_ord INT, chunk_type STRING, heading STRING, piece INT, text STRING)
        RETURN SELECT x.type_ord, x.chunk_type, x.heading, x.piece, x.text FROM (SELECT inline(flatten(transform(array(
            named_struct('type_ord', 0, 'chunk_type', 'page_summary', 'heading', {_clean('title')},
                         'text', concat('Page title: ', {_clean('title')})),
            named_struct('type_ord', 2, 'chunk_type', 'paragraph_group', 'heading', '', 'text', {_clean('body')})),
          k -> {windows('k.text', piece)})))) x
        """
    )

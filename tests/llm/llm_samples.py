"""Rows with every odd case."""

LINE = "the quick brown fox jumps over the lazy dog again and again.\n"
#: Rows with every odd case: NULL and empty texts, NULL and repeated ids, repeated rows, ties, one very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one  two"), (7, LINE * 3), (8, LINE * 3), (8, LINE * 3), (9, "é" * 500),
    (10, "x" * 5000), (None, LINE * 3), (None, None), (11, "Émile! <|endoftext|> 中文 \U0001f600"), (12, LINE * 400 + "tail"), (7, "another text of one id"),
]

"""Rows that every operator over documents must take."""

#: Nulls, empty and very long texts, ties, repeated rows, odd white space and scripts.
EDGES = [(5, None), (1, ""), (2, "one"), (2, "one"), (2, "Two words\n\nand more  space "), (None, "no id"),
         (7, "Ünï’s ß ÀÉ '\x1c'\x85 a b　c don't we'll 12 345 <|endoftext|> x́y ́z"),
         (8, "한국어 中文\U0001f600\U0001f600 İΣς"), (9, "lorem ipsum dolor. " * 9000), (10, "z" * 50_000)]

"""Rows shared by the tests of the text operators."""

SF = "/root/testdata/sf0.001"
ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"), (None, "no id here at all"),
    (None, None), (6, "a" * 5000), (7, "word " * 3000), (8, "Zeile eins\nZeile zwei\n\nZeile eins\r\n"),
    (9, "<|endoftext|> ünïcödé 漢字    \U0001f600 \x1c x\x85y"),
]

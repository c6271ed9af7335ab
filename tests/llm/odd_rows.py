#: rows that every operator must take
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three"), (None, None), (5, "x" * 50_000), (6, "word " * 20_000), (7, "Ünïcode ñ 漢字 😀 a b c d"), (8, "a\nb\n\nc")]

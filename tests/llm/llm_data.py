"""Texts that the tests share."""

#: Nulls, empty and blank texts, ties, one long text without a break, scripts, marks and control characters.
ODD = [None, "", " ", "\n\n \t", "a", "a", "▁▁a b\n\n c", "x" * 5000, "日本 語\x00é😀", "don't <s> </s> <|endoftext|> ΣΑΣ ς İ ﬁ", "one two three four five six " * 40, "\x1c\x85\xa0²½ 12", "Hello, world! " * 300, "Hello, world! " * 300]

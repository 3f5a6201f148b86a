"""Rows that every operator must take."""

#: A row of every awkward kind: null id, null text, empty, blank, beyond ASCII, repeated rows, equal texts, a very long text.
AWKWARD = [
    (None, "no id here at all", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (4, "Ünïcödé 😀 日本語", "de", "b"),
    (5, "one two three four five six seven", "en", "a"), (5, "one two three four five six seven", "en", "a"), (6, "one two three four five six seven", "en", None),
    (7, "a" * 50_000, None, "c"), (8, "lorem ipsum " * 20_000, "en", "a"), (-9, "123 456 !!!", "en", "c"), (9223372036854775807, "a\n\nb\n a \nB", "fr", "b"),
    (10, "\x00 nul ​ zero", None, "a"), (11, "K", "en", "a"), (None, None, None, None),
]

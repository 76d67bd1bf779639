"""Ids against the tokenizers file as it is loaded, added tokens in the text included."""

import random

from takeoff.llm import packing


def test_added_tokens_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    assert not any(" " in t for t in packing.added_tokens(packing.rank_file()))  # long texts are cut at blanks
    rng = random.Random(2)
    some = [f"one two{end}three", end, end + end, f"a {end} b", f"  {end}\n", f"x{end[:-1]}", "some words and more " * 4000 + end + " and words" * 9000]
    some += ["".join(rng.choices([end, " ", "a", "'s", "\n", "<|", "12", "é"], k=12)) for _ in range(200)]
    for t in some:
        assert packing.token_ids(t, packing.rank_file()).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t

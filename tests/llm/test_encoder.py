"""The packing's ids against the JSON file's library as it is loaded."""

import public_tokenizers as P
from tokenizers import Tokenizer

from quillmark.llm import packing


def libraries():
    ranks, path = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    return packing.Encoder(ranks, path, P.PATTERN), Tokenizer.from_file(path)


def test_added_tokens_are_one_id():
    encode, library = libraries()
    assert encode.added
    for token in encode.added:
        for text in (f"x {token} y", token, f"{token}{token}", f"é{token}\n", f"你 {token} 好", token[:-1], f"<{token}"):
            assert encode.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_codepoint_below_the_border():
    encode, library = libraries()
    points = [chr(c) for c in range(ord(packing.AGREED))]
    texts = [t for c in points for t in (f"a{c}b {c} 1{c}", f"{c}{c}  {c}'s", f"{c}\n{c}é{c}9")]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(encode.fast.encode_ordinary(t) == w.ids for t, w in zip(texts, want))

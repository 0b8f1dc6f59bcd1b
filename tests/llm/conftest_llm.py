"""What the tests of this folder share."""

import public_tokenizers

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def prefix_table(encoder, piece):
    return encoder.extend(piece, [-1])

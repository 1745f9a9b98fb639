from mediamatch.functions.hashes import (
    bits_to_hex,
    block_hash,
    hamming,
    hamming_hex,
    hash_to_long,
    is_valid_hash,
    long_to_hash,
)
from mediamatch.functions.labels import error_label, human_bytes, percent_to_ratio, ratio_to_percent, row_status
from mediamatch.functions.paths import basename, client_address, client_key, epoch_to_text, mime_from_name
from mediamatch.functions.similarity import (
    DEFAULT_PARTS,
    bhattacharyya,
    composite_score,
    cosine,
    decode_vector,
    encode_vector,
)

__all__ = [
    "DEFAULT_PARTS",
    "basename",
    "bhattacharyya",
    "bits_to_hex",
    "block_hash",
    "client_address",
    "client_key",
    "composite_score",
    "cosine",
    "decode_vector",
    "encode_vector",
    "epoch_to_text",
    "error_label",
    "hamming",
    "hamming_hex",
    "hash_to_long",
    "human_bytes",
    "is_valid_hash",
    "long_to_hash",
    "mime_from_name",
    "percent_to_ratio",
    "ratio_to_percent",
    "row_status",
]

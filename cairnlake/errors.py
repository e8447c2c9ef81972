"""Error classes. Bulk operators put their names into ``error_class`` columns; strict wrappers raise them."""

from __future__ import annotations


class LakeError(Exception):
    """Base of all errors of the library."""


def _error(name: str, doc: str) -> type[LakeError]:
    return type(name, (LakeError,), {"__doc__": doc, "__module__": __name__})


InvalidHashLength = _error("InvalidHashLength", "A hash is not 32 bytes long.")
InvalidHex = _error("InvalidHex", "A text is no hexadecimal number of whole bytes.")
InvalidCdcParams = _error("InvalidCdcParams", "Chunk bounds break 0 < min <= avg <= max or are odd.")
CompressError = _error("Compress", "Bytes could not be compressed.")
DecompressError = _error("Decompress", "Stored bytes could not be decompressed.")
InvalidCodec = _error("InvalidCodec", "Unknown codec name.")
MissingMeta = _error("MissingMeta", "An index has no value of this name.")
HashMismatch = _error("HashMismatch", "Content does not have the hash it is put under.")
ObjectLengthMismatch = _error("ObjectLengthMismatch", "Decoded content has another length than recorded.")
ObjectHashMismatch = _error("ObjectHashMismatch", "Decoded content has another hash than recorded.")
Integrity = _error("Integrity", "A stored structure contradicts itself.")
ObjectNotFound = _error("ObjectNotFound", "No object has this hash.")
InvalidConfig = _error("InvalidConfig", "A setting or call is not allowed.")
InvalidSealed = _error("InvalidSealed", "A sealed pack is malformed.")
AuthenticationFailed = _error("AuthenticationFailed", "A sealed frame or index does not authenticate.")
DuplicateTransformDecoder = _error("DuplicateTransformDecoder", "Two decoders have one id and version.")
UnsupportedTransform = _error("UnsupportedTransform", "No decoder has this id and version.")
ObjectKindMismatch = _error("ObjectKindMismatch", "An object is of another kind than needed.")
RecipeChunkLengthMismatch = _error("RecipeChunkLengthMismatch", "A chunk has another length than its recipe says.")
InvalidRecipe = _error("InvalidRecipe", "Recipe bytes are malformed.")
FileReadLimitExceeded = _error("FileReadLimitExceeded", "A file exceeds a read limit.")
OriginalFileMismatch = _error("OriginalFileMismatch", "A restored file has another size or hash than recorded.")

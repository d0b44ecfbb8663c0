from .scalars import (
    file_name,
    human_size,
    is_supported,
    last_modified_utc,
    parse_extensions,
    short_hash,
    top_level_dir,
)

__all__ = [
    "file_name",
    "human_size",
    "is_supported",
    "last_modified_utc",
    "parse_extensions",
    "short_hash",
    "top_level_dir",
]

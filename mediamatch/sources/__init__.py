from mediamatch.sources.images import admit_probes, file_facts, read_images
from mediamatch.sources.results import read_groups, last_scanned, write_groups
from mediamatch.sources.text_images import text_as_image

__all__ = [
    "admit_probes",
    "file_facts",
    "last_scanned",
    "read_groups",
    "read_images",
    "text_as_image",
    "write_groups",
]

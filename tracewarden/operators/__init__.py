"""Set-at-a-time operators over turns, facts and vocabularies."""

"""Training-data operators: quality, packing, extraction, licences, near copies, chat, leaks, repeats, urls, personal data."""

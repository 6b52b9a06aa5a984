"""Training-data operators: decontamination, licences, language, near-duplicates, mixing, search, sharding, secrets, URLs, chats."""

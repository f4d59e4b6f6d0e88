"""Column functions: text, URLs, labels, identities. All are Catalyst expressions but ``text.nfkc``."""

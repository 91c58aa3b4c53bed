"""A front end for Go source: lexer, parser and a checker good enough for code navigation."""

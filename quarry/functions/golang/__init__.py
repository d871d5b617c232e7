"""Go source to structural tokens: scanner, parser and token walk, in plain Python."""

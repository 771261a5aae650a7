"""Column functions on sequences; `sequence.register` also offers them to SQL."""

"""Writers of Word and Excel files from plans."""

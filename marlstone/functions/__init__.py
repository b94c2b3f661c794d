"""Part of marlstone; see the README for the list of operators."""

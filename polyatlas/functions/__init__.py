"""Column functions: identities, label classifiers and distribution tails."""

"""Spark plans for collections of business documents, and for the training data made of them."""

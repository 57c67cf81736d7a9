"""biblioflux.operators"""

"""biblioflux.streaming"""

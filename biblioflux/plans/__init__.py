"""biblioflux.plans"""
